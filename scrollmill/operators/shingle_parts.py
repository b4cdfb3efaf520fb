"""The scan of shingle.py for sessions that no task should hold: which places repeat an earlier one is found over all tasks, and the walk sees runs of such places, without texts.

The class of a window of `size` units is the first place of the session that has the same ones. Windows that share an anchor,
their least hash of half the size, are compared by their text; of texts that follow each other so are the windows across
their border, into which a match may go on. What the walk has to know of an earlier place follows from the classes: it was
registered unless its window crosses a border, lies in a protected text or starts in a span that became a marker.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrollmill.functions.text import utf16_len
from scrollmill.schema import ShingleOptions
from scrollmill.storage import cut, tidy

#: Code units that are hashed at once, and parts of the table that tells which anchors may occur again.
SLICE, PARTS = 1 << 19, 128
RUNS = "sid long, key long, at int, qkey long, qat int, len int, weights binary"
PACKED = "sid long, key long, first int, at binary, qkey binary, qat binary, len binary, flags binary, weights binary"
SPANS = "sid long, key long, at int, n int, source long, bytes long, src long"


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` units at each place of the last axis, put together from windows of powers of two."""
    n = codes.shape[-1] - size + 1
    part, width, have, out = _mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, 0, None
    while True:
        if size & width:
            piece = part[..., have : have + n]
            out, have = piece if out is None else _mix(out * np.uint64(5) + piece), have + width
        if width * 2 > size:
            return out
        part = _mix(part[..., :-width] * np.uint64(3) + part[..., width:])
        width *= 2


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Where the least of w values from each place on is, the first of several."""
    at, width = np.arange(len(values), dtype=np.int32), 1
    while width < w:
        step = min(width, w - width)
        right = values[step:] < values[:-step]
        values, at = np.where(right, values[step:], values[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    return at


def _weights(codes: np.ndarray) -> np.ndarray:
    """Bytes of each unit in UTF-8: a pair has its four with the first half."""
    out = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, 3)).astype(np.uint8)
    out[(codes >= 0xD800) & (codes < 0xDC00)] = 4
    out[(codes >= 0xDC00) & (codes < 0xE000)] = 0
    return out


def _anchors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(sid, key, at, off, n, hash, codes, lo) of the anchors of the texts (sid, key, n, text, next): the n windows from `at` on have the anchor `off` units further; their units start at codes[lo]."""
    g = max(1, size // 2)

    def told(rows: list[tuple]) -> tuple | None:
        codes = np.concatenate([r[3] for r in rows])
        if len(codes) < size:
            return None
        lens = np.array([len(r[3]) for r in rows])
        ends = np.cumsum(lens)
        sid, key, base = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        row = np.repeat(np.arange(len(rows)), lens)[: len(codes) - size + 1]
        grams = _hashes(codes, g)
        place = np.flatnonzero(np.arange(len(row)) + size <= ends[row])
        anchor = _least(grams, size - g + 1)[place]
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]] if len(anchor) else np.zeros(0, bool))
        lo, own = place[new], row[place[new]]
        n = np.diff(np.r_[new, len(place)])
        h = _mix(_mix(grams[anchor[new]] ^ sid[own].view(np.uint64)))
        return sid[own], key[own], (base[own] + lo - (ends - lens)[own]).astype(np.int32), (anchor[new] - lo).astype(np.int32), n.astype(np.int32), h, codes, lo

    for batch in batches:
        rows, have = [], 0
        for sid, key, n, text, after in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3), batch.column(4), strict=True):
            codes, base = _units(text.as_py()), 0
            if after.is_valid:  # of the border alone
                codes = codes[max(0, len(codes) - size + 1) :]
                codes, base = np.concatenate([codes, _units(after.as_py())[: size - 1]]), n - len(codes)
            for a in range(0, max(1, len(codes) - size + 1), SLICE):
                piece = codes[a : a + SLICE + size - 1]
                rows.append((sid, key, base + a, piece))
                have += len(piece)
                if have >= SLICE:
                    if out := told(rows):
                        yield out
                    rows, have = [], 0
        if rows and (out := told(rows)):
            yield out


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(57)).astype(np.int32), ((h >> np.uint64(25)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _again(stream: DataFrame, size: int, n_units: int) -> tuple[np.ndarray, int]:
    """A table of bits, PARTS rows: those of anchors that occur again are set, and some others. Its size is bounded."""
    n_anchors = 2 * n_units / (size - max(1, size // 2) + 2)
    bits = min(23, max(6, int(2 * n_anchors / PARTS).bit_length()))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            part, low = _slots(np.concatenate(held))
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(PARTS + 1))
            some = [k for k in range(PARTS) if ends[k] < ends[k + 1]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([low[order[ends[k] : ends[k + 1]]].tobytes() for k in some], pa.binary())], ["part", "lows"])

        for x in _anchors(batches, size):
            held.append(x[5])
            n += len(x[5])
            if n >= 1 << 18:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def table(rows: pa.Table) -> pa.Table:
        low = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("lows").to_pylist()]))
        bitmap = np.zeros(1 << bits, bool)
        bitmap[low[1:][low[1:] == low[:-1]] >> np.uint32(32 - bits)] = True
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bitmap).tobytes()], pa.binary())})

    found = stream.mapInArrow(sent, "part int, lows binary").groupBy("part").applyInArrow(table, "part int, bits binary").toArrow()
    out = np.zeros((PARTS, max(1, (1 << bits) // 8)), np.uint8)
    for part, row in zip(found.column("part").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[part] = np.frombuffer(row, np.uint8)
    return out, bits


def _contexts(stream: DataFrame, size: int, n_units: int) -> DataFrame:
    """(hash, sid, key, at, off, n, wide, units): the anchors that may occur again, with the units of their windows."""
    table, bits = _again(stream, size, n_units)
    shared = stream.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sid, key, at, off, n, h, codes, lo in _anchors(batches, size):
            part, low = _slots(h)
            slot = low >> np.uint32(32 - bits)
            keep = np.flatnonzero(shared.value[part, slot >> np.uint32(3)] >> (7 - (slot & np.uint32(7))).astype(np.uint8) & 1)
            lens = n[keep] + size - 1
            wide = np.maximum.reduceat(np.r_[codes, np.uint16(0)], np.stack([lo[keep], lo[keep] + lens], axis=1).ravel())[::2] > 255 if len(keep) else np.zeros(0, bool)
            for big in (False, True):
                k, m = keep[wide == big], lens[wide == big]
                if not len(k):
                    continue
                ends = np.cumsum(m)
                flat = codes[np.repeat(lo[k] - (ends - m), m) + np.arange(ends[-1])]
                flat = flat if big else flat.astype(np.uint8)
                offsets = (np.r_[0, ends] * flat.itemsize).astype(np.int32)
                texts = pa.BinaryArray.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(h[k].view(np.int64)), *[pa.array(x[k]) for x in (sid, key, at, off, n)], pa.array(np.full(len(k), big)), texts], ["hash", "sid", "key", "at", "off", "n", "wide", "units"])

    return stream.mapInArrow(run, "hash long, sid long, key long, at int, off int, n int, wide boolean, units binary")


def _classes(sid: np.ndarray, h: np.ndarray, off: np.ndarray, n: np.ndarray, units: np.ndarray, size: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, first row) of each window of rows in order, the first row being that with the same window at the same distance from the same anchor."""
    lo = w - 1 - off
    columns = np.arange(w)
    row, col = np.nonzero((columns >= lo[:, None]) & (columns < (lo + n)[:, None]))
    group = np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])]).astype(np.uint64)
    k = _mix(_hashes(units, size)[row, col] + _mix(group[row] * np.uint64(w) + col.astype(np.uint64)))
    order = np.argsort(k, kind="stable")
    new = np.r_[True, k[order][1:] != k[order][:-1]]
    first = np.empty(len(k), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    # Hashes propose, texts decide: a run of windows is compared at once.
    old, start = row[first], np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1) | (row[first][1:] != row[first][:-1])])
    last = np.r_[start[1:], len(row)] - 1
    every = np.arange(units.shape[1])
    same = (col[first] == col).all() and (group[old] == group[row]).all()
    for a in range(0, len(start), 1 << 13):
        s, e = start[a : a + (1 << 13)], last[a : a + (1 << 13)]
        inside = (every >= col[s][:, None]) & (every < (col[e] + size)[:, None])
        same = same and not ((units[row[s]] != units[old[s]]) & inside).any()
    if not same:
        seen: dict[tuple, int] = {}
        old = np.array([seen.setdefault((int(group[r]), int(c), units[r, c : c + size].tobytes()), int(r)) for r, c in zip(row, col, strict=True)])
    return row, col, old


def _found(contexts: DataFrame, size: int) -> DataFrame:
    """RUNS of windows that have occurred before in their session, and where first; not yet put together."""
    w = size - max(1, size // 2) + 1
    width = w - 1 + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[np.ndarray] | None = None
        for whole in batches:
            for batch in (whole.slice(a, 1 << 12) for a in range(0, len(whole), 1 << 12)):
                h, sid, key, at, off, n, wide = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
                units = np.zeros((len(batch), width), np.uint16)
                for r, x in enumerate(batch.column(7)):
                    codes = np.frombuffer(x.as_buffer(), np.uint16 if wide[r] else np.uint8)
                    units[r, w - 1 - off[r] :][: len(codes)] = codes
                rows = [h, sid, key, at, off, n, units]
                known = 0
                if carried is not None and (carried[0][0], carried[1][0]) == (h[0], sid[0]):
                    known, rows = len(carried[0]), [np.concatenate(x) for x in zip(carried, rows, strict=True)]
                h, sid, key, at, off, n, units = rows
                row, col, old = _classes(sid, h, off, n, units, size, w)
                # The rows that hold a first window of the last anchor, for those of it that follow.
                keep = np.unique(row[(row == old) & (h[row] == h[-1]) & (sid[row] == sid[-1])])
                carried = [x[keep] for x in rows]
                mine = np.flatnonzero((row >= known) & (old != row))
                if not len(mine):
                    continue
                row, col, old = row[mine], col[mine], old[mine]
                start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1) | (old[1:] != old[:-1])])
                length = np.diff(np.r_[start, len(row)])
                row, col, old = row[start], col[start], old[start]
                place = at[row] + col - (w - 1 - off[row]), at[old] + col - (w - 1 - off[old])
                weigh = _weights(units)
                every = np.arange(width)
                plain = ~((weigh[row] != 1) & (every >= col[:, None]) & (every < (col + length + size - 1)[:, None])).any(axis=1)
                told = [None if p else weigh[r, c : c + m].tobytes() for p, r, c, m in zip(plain.tolist(), row.tolist(), col.tolist(), (length + size - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(sid[row]), pa.array(key[row]), pa.array(place[0].astype(np.int32)), pa.array(key[old]), pa.array(place[1].astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(told, pa.binary())], ["sid", "key", "at", "qkey", "qat", "len", "weights"])

    return contexts.repartition("hash").sortWithinPartitions("hash", "sid", "key", "at").mapInArrow(run, RUNS)


def _joined(found: DataFrame, size: int) -> DataFrame:
    """PACKED: the runs of a text in few rows, those that go on from each other put together."""

    def merged(t: pa.Table) -> pa.Table:
        sid, key, at, qkey, qat, n = (t.column(k).to_numpy() for k in range(6))
        start = np.flatnonzero(np.r_[True, (sid[1:] != sid[:-1]) | (key[1:] != key[:-1]) | (qkey[1:] != qkey[:-1]) | (at[1:] != at[:-1] + n[:-1]) | (qat[1:] != qat[:-1] + n[:-1])])
        end = np.r_[start[1:], len(at)]
        told = t.column("weights").to_pylist()
        some = np.logical_or.reduceat(np.array([x is not None for x in told]), start)

        def one(a: int, b: int) -> bytes:
            every = [told[k] or b"\1" * (int(n[k]) + size - 1) for k in range(a, b)]
            return b"".join([*[x[: len(x) - size + 1] for x in every[:-1]], every[-1]])

        weights = [one(a, b) if x else None for a, b, x in zip(start.tolist(), end.tolist(), some.tolist(), strict=True)]
        return pa.table([pa.array(sid[start]), pa.array(key[start]), pa.array(at[start]), pa.array(qkey[start]), pa.array(qat[start]), pa.array(np.add.reduceat(n, start).astype(np.int32)), pa.array(weights, pa.binary())], names=t.column_names)

    def packed(t: pa.Table) -> pa.RecordBatch:
        sid, key, at, qkey, qat, n = (t.column(k).to_numpy() for k in range(6))
        told = t.column("weights").to_pylist()
        flags = np.array([x is not None for x in told], bool)
        start = np.flatnonzero(np.r_[True, (sid[1:] != sid[:-1]) | (key[1:] != key[:-1])])
        ends = list(zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True))
        blobs = [pa.array([x[a:b].tobytes() for a, b in ends], pa.binary()) for x in (at, qkey, qat, n, flags)]
        return pa.RecordBatch.from_arrays([pa.array(sid[start]), pa.array(key[start]), pa.array(at[start]), *blobs, pa.array([b"".join(x for x in told[a:b] if x is not None) for a, b in ends], pa.binary())], ["sid", "key", "first", "at", "qkey", "qat", "len", "flags", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if len(batch):
                t = merged(pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])]).combine_chunks())
                # The last may go on in the next batch.
                t, held = t.slice(0, len(t) - 1), t.slice(len(t) - 1)
                if len(t):
                    yield packed(t.combine_chunks())
        if held is not None:
            yield packed(held.combine_chunks())

    return found.repartition("sid", "key").sortWithinPartitions("sid", "key", "at").mapInArrow(run, PACKED)


class Walk:
    """The walk of a session over its texts (key, n, protected, ref_len) and their runs, PACKED."""

    def __init__(self, texts: pa.Table, runs: pa.Table, options: ShingleOptions):
        self.size, self.least = options.shingle, max(options.min_repeat, options.shingle)
        order = np.argsort(texts.column("key").to_numpy())
        self.key, self.n, self.protected, self.ref_len = (texts.column(c).to_numpy()[order] for c in ("key", "n", "protected", "ref_len"))
        self.starts = np.cumsum(self.n) - self.n

        rows = np.lexsort((runs.column("first").to_numpy(), runs.column("key").to_numpy()))
        keys = runs.column("key").to_numpy()[rows]

        def column(name: str, kind: type) -> np.ndarray:
            held = runs.column(name).combine_chunks()
            return np.frombuffer(b"".join([held[int(r)].as_buffer() for r in rows]), kind)

        at = column("at", np.int32)
        self.p = np.repeat(self.starts[np.searchsorted(self.key, keys)], pc.binary_length(runs.column("at")).to_numpy()[rows] // 4) + at
        self.q = self.starts[np.searchsorted(self.key, column("qkey", np.int64))] + column("qat", np.int32)
        self.len, self.flags = column("len", np.int32), column("flags", bool)
        #: Bytes of the units of runs that are not plain ASCII, one after the other, and where those of each run end.
        self.weights = column("weights", np.uint8)
        self.weight_ends = np.cumsum(np.where(self.flags, self.len.astype(np.int64) + self.size - 1, 0))
        #: Spans that became markers.
        self.gone: list[int] = []
        self.ends: list[int] = []
        #: Of classes whose first place is not registered, the one that is.
        self.moved: dict[int, int] = {}

    def _segment(self, p: int) -> tuple[int, int]:
        """The class of the window at p, and how many from there on have the classes that follow it."""
        i = bisect_right(self.p, p) - 1
        if i >= 0 and p < self.p[i] + self.len[i]:
            return int(self.q[i]) + p - int(self.p[i]), int(self.p[i] + self.len[i]) - p
        return p, int(self.p[i + 1]) - p if i + 1 < len(self.p) else 1 << 62

    def _alike(self, p: int, q: int, most: int) -> int:
        """How many windows from p and from q on are the same."""
        have = 0
        while have < most:
            a, n = self._segment(p + have)
            b, m = self._segment(q + have)
            if a != b:
                break
            have += min(n, m)
        return min(have, most)

    def _registered(self, c: int) -> int:
        """How many places from c on are registered, as places of their first window; 0 if c is not."""
        t = bisect_right(self.starts, c) - 1
        if self.protected[t]:
            return 0
        n = int(self.starts[t] + self.n[t]) - self.size + 1 - c
        i = bisect_right(self.gone, c) - 1
        if n <= 0 or i >= 0 and c < self.ends[i]:
            return 0
        return min(n, self.gone[i + 1] - c) if i + 1 < len(self.gone) else n

    def _span(self, i: int, p: int, n: int) -> tuple[int, int, int]:
        """(start, end, bytes) of the n units from p on, which is in run i, without halves of characters."""
        lo, hi, end, size = p, p + n, p + n, 0
        while True:
            first, after = int(self.p[i]), int(self.p[i]) + int(self.len[i])
            last = end <= after + self.size - 1
            upto = end if last else after
            if self.flags[i]:
                base = int(self.weight_ends[i]) - (after - first + self.size - 1) - first
                w = self.weights[base + p : base + upto]
                size += int(w.sum())
                lo += p == lo and w[0] == 0
                if last and w[-1] == 4:
                    hi, size = hi - 1, size - 4
            else:
                size += upto - p
            if last:
                return lo, hi, size
            p, i = after, i + 1

    def spans(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(key, at, n, source, bytes, key of the source) of what becomes a marker, in order."""
        fixed = len("[repeated substring,  bytes, see earlier occurrence in toolCallId ]")
        i = 0
        while i < len(self.p):
            t = bisect_right(self.starts, self.p[i]) - 1
            start = int(self.starts[t])
            windows_end = start + int(self.n[t]) - self.size + 1
            at = int(self.p[i])
            if self.protected[t] or at >= windows_end:
                i = bisect_left(self.p, start + int(self.n[t]), i)
                continue
            known = (0, 0)  # the distance last looked at and where its match ends
            while i < len(self.p):
                at = max(at, int(self.p[i]))
                if at >= windows_end:
                    break
                end = min(int(self.p[i] + self.len[i]), windows_end)
                if at >= end:
                    i += 1
                    continue
                c = int(self.q[i]) + at - int(self.p[i])
                sure = self._registered(c)
                q = c if sure else self.moved.get(c)
                if q is None:
                    self.moved[c] = at
                    at += 1
                    continue
                if known[0] != at - q or known[1] <= at:
                    known = at - q, at + self._alike(at, q, windows_end - at) + self.size - 1
                n = known[1] - at
                source = bisect_right(self.starts, q) - 1
                if n >= self.least and n > fixed + int(self.ref_len[source]):
                    lo, hi, size = self._span(i, at, n)
                    if hi - lo >= self.least and fixed + len(str(size)) + int(self.ref_len[source]) < hi - lo:
                        yield int(self.key[t]), lo - start, hi - lo, q + lo - at, size, int(self.key[source])
                        self.gone.append(at)
                        self.ends.append(at + n)
                        at += n
                        i = bisect_right(self.p, at, i) - 1
                        continue
                # From the next place on the same match is shorter still, and so no better.
                at = min(end, at + max(sure, 1))
            i = bisect_left(self.p, start + int(self.n[t]), max(0, i - 1))


def _numbered(texts: DataFrame) -> DataFrame:
    """texts with sid, a number by which no two sessions agree, and key, which sorts as msg_idx and block_idx do."""
    names = cut(texts.select("session_id").distinct(), "sessions")
    key = F.shiftleft(F.col("msg_idx").cast("long"), 32) + F.col("block_idx").cast("long")
    for seed in range(99):
        sid = F.xxhash64(F.lit(seed), "session_id")
        if names.groupBy(sid.alias("sid")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return texts.withColumns({"sid": sid, "key": key})
    raise ValueError("sessions that no hash tells apart")


def _spans(texts: DataFrame, options: ShingleOptions) -> DataFrame:
    """(sid, key, spans) of the texts that change; spans is in order and has ref and bytes, for the markers. Written."""
    size = options.shingle
    texts = texts.where(F.length("text") > 0)
    n, after = utf16_len(F.col("text")), Window.partitionBy("sid").orderBy("key").rowsBetween(1, max(1, size - 1))
    narrow = texts.select("sid", "key", n.alias("n"), "protected", "ref", F.substring("text", 1, size - 1).alias("head"), F.right("text", F.lit(size - 1)).alias("last"))
    narrow = cut(narrow.withColumn("next", F.substring(F.array_join(F.collect_list("head").over(after), ""), 1, size - 1)).drop("head"), "shingle-texts")
    n_units = narrow.agg(F.sum("n")).first()[0] or 0
    borders = narrow.where((F.length("next") > 0) & (F.length("last") > 0)).select("sid", "key", "n", F.col("last").alias("text"), "next")
    stream = texts.select("sid", "key", n.alias("n"), "text", F.lit(None).cast("string").alias("next")).unionByName(borders)
    runs = cut(_joined(_found(_contexts(stream, size, n_units), size), size), "shingle-runs")

    def walk(of: pa.Table, found: pa.Table) -> pa.Table:
        kinds = (np.int64, np.int32, np.int32, np.int64, np.int64, np.int64)
        rows = array("q")
        if len(of) and len(found):
            for x in Walk(of, found, options).spans():
                rows.extend(x)
        flat = np.frombuffer(rows, np.int64).reshape(-1, 6) if rows else np.zeros((0, 6), np.int64)
        sid = np.full(len(flat), of.column("sid")[0].as_py() if len(of) else 0, np.int64)
        return pa.Table.from_arrays([pa.array(sid), *[pa.array(flat[:, k].astype(kind)) for k, kind in enumerate(kinds)]], ["sid", "key", "at", "n", "source", "bytes", "src"])

    known = narrow.select("sid", "key", "n", "protected", utf16_len(F.col("ref")).alias("ref_len"))
    spans = known.groupBy("sid").cogroup(runs.groupBy("sid")).applyInArrow(walk, SPANS)
    refs = narrow.select("sid", F.col("key").alias("src"), "ref")
    each = spans.join(refs, ["sid", "src"]).groupBy("sid", "key").agg(F.array_sort(F.collect_list(F.struct("at", "n", "source", "bytes", "ref"))).alias("spans"))
    return cut(each, "shingle-spans")


def texts_by_parts(texts: DataFrame, options: ShingleOptions) -> DataFrame:
    """What shingle.shingle_texts gives, for sessions of any length; no session has a (msg_idx, block_idx) twice."""
    out = "session_id string, msg_idx int, block_idx int, new_text string, spans array<struct<at:int,n:int,source:long>>"
    kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("source", pa.int64())]))

    def one(text: str, spans: list[dict]) -> str:
        codes, parts, copied = _units(text), [], 0
        for s in spans:
            parts += [codes[copied : s["at"]].tobytes().decode("utf-16-le", "surrogatepass"), f"[repeated substring, {s['bytes']} bytes, see earlier occurrence in toolCallId {s['ref']}]"]
            copied = s["at"] + s["n"]
        return "".join([*parts, codes[copied:].tobytes().decode("utf-16-le", "surrogatepass")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(4).to_pylist()
            new = [one(t.as_py(), s) for t, s in zip(batch.column(3), found, strict=True)]
            told = [[{c: x[c] for c in ("at", "n", "source")} for x in s] for s in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(new, pa.string()), pa.array(told, kind)], ["session_id", "msg_idx", "block_idx", "new_text", "spans"])

    with tidy(texts.sparkSession):
        texts = _numbered(texts)
        spans = _spans(texts, options)
    return texts.join(spans, ["sid", "key"]).select("session_id", "msg_idx", "block_idx", "text", "spans").mapInArrow(run, out)
