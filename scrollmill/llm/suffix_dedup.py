"""Removal of repeated passages by a distributed merge sort of suffixes that never compares a known prefix twice.

Two equal strings of SPAN bytes select, by winnowing, the same GRAM-byte anchors at the same places. So only suffixes
that start at anchors are sorted, and only at anchors that lie in two documents at least:

1. Documents are packed into batches, a table bucketed by batch that is written once and never shuffled again.
2. Each batch sends its sorted distinct anchor hashes, cut by key range, to the owners of the ranges, which send back
   which of them other documents have as well.
3. For those, each batch makes a run of its distinct suffixes (the bytes from the anchor on, then those before it
   backwards), sorted and front-coded: common prefix with the one before, and the rest.
4. An owner merges the runs of its range with a loser tree whose entries carry their common prefix with the last winner.
   Unequal prefixes decide at once; equal ones are compared from there on. The prefixes of the merged order say which
   suffixes share the bytes from the anchor on; those before it are put in order in turn. So each string of SPAN bytes
   around an anchor gets the least document that has it, block by block of the merged order.
5. Batches take these back and remove, in each document, what a smaller one has.

A suffix leaves a batch once, however many of its documents have it. An anchor that many batches have, with ever other
bytes around it, is dealt to owners by these bytes: once by those after it, for strings that start near it, and once by
those before it, for the others. An owner holds its runs front-coded and spells out a part of each at a time.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmill.llm.common import cut, freeing, shared_dir, small_batches
from scrollmill.llm.shingles import MULTIPLIER, mix64, slices

SPAN, GRAM = 50, 20
#: Places of an anchor in a string of SPAN bytes.
PLACES = SPAN - GRAM + 1
#: Bytes of text in a batch; a longer text is a batch of its own.
BATCH = 1_000_000
#: Batches from which on an anchor is dealt by the bytes around it.
HOT = 128
#: Suffixes of a run that are spelt out at once, and of a block of the merged order, which ends with an anchor.
CHUNK, BLOCK = 256, 1 << 15
#: A string that starts at most so many bytes before its anchor has SPAN - NEAR bytes from there on; any other has more before it.
NEAR = PLACES // 2
FIRST = -(1 << 63)


# Anchors


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _powers(n: int) -> np.uint64:
    return np.uint64(pow(int(MULTIPLIER), n, 1 << 64))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    h = _BYTES[b]
    have, four = 1, h
    while have < 16:
        h = h[:-have] * _powers(have) + h[have:]
        have *= 2
        if have == 4:
            four = h
    n = len(b) - GRAM + 1
    h = h[:n] * _powers(4) + four[16 : 16 + n]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def anchors(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, their bounds, and places and hashes of the anchors of all their strings of SPAN bytes.

    A string's anchors are the grams in it whose hash has the least leading half. Their hashes are scattered anew, as
    minima lie close together.
    """
    joined = b"".join(texts)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    none = np.zeros(0, np.int64)
    if len(joined) < SPAN:
        return joined, bounds, none, none.astype(np.uint64)
    h = gram_hashes(np.frombuffer(joined, np.uint8))
    rank = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = _slide(rank, PLACES, np.minimum)
    edge = np.zeros(len(joined) + 1, np.int32)  # strings that would run over a text's end
    np.add.at(edge, np.maximum(bounds[1:] - SPAN + 1, bounds[:-1]), 1)
    np.add.at(edge, bounds[1:], -1)
    low[np.cumsum(edge)[: len(low)] > 0] = 0
    pad = np.zeros(PLACES - 1, np.uint32)
    at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), PLACES, np.maximum) == rank)
    return joined, bounds, at, mix64(h[at])


class Batch:
    """A batch's texts with its anchors, by distinct hash in sorted order."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids = [FIRST if i is None else i for i in ids]
        self.joined, self.bounds, at, h = anchors([(t or "").encode() for t in texts])
        order = np.argsort(h, kind="stable")
        self.at, h = at[order], h[order]
        self.doc = np.searchsorted(self.bounds, self.at, side="right") - 1
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        self.starts = np.flatnonzero(new)
        self.hashes = h[self.starts]
        ends = np.concatenate([self.starts[1:], [len(h)]]).astype(np.int64)
        self.ends = ends
        self.several = self.doc[self.starts] != self.doc[ends - 1] if len(h) else new

    def ranges(self, owners: int) -> list[tuple[int, int, int]]:
        """[(owner, lo, hi)] of the distinct hashes, an owner having a range of them."""
        own = ((self.hashes >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        cuts = np.searchsorted(own, np.arange(owners + 1, dtype=np.uint64))
        return [(o, lo, hi) for o, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if hi > lo]

    def suffixes(self, shared: dict[int, tuple[bytes, bytes]], owners: int) -> Suffixes:
        """The suffixes at shared anchors; shared has two bits for each key of an owner, shared and hot."""
        flags = np.zeros((2, len(self.hashes)), bool)
        own = np.zeros(len(self.hashes), np.int64)
        for owner, lo, hi in self.ranges(owners):
            own[lo:hi] = owner
            for k, bits in enumerate(shared.get(owner, ())):
                flags[k, lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
        sizes = self.ends - self.starts
        at = np.repeat(flags[0], sizes)
        return Suffixes(self.joined, self.bounds, self.at[at], self.doc[at], np.repeat(own, sizes)[at], np.repeat(flags[1], sizes)[at], owners)


def _dealt(rows: np.ndarray, owners: int) -> np.ndarray:
    """An owner for each row of bytes."""
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = h * MULTIPLIER + rows[:, k] + np.uint64(1)
    return (mix64(h) % np.uint64(owners)).astype(np.int64)


class Suffixes:
    """Distinct suffixes (keys, a row of WIDTH bytes each) sorted by owner, then bytes; suffix k has the places q[first[k]:first[k + 1]] of texts d[...].

    A key is the SPAN bytes from the anchor on, the PLACES - 1 before it backwards, zeros where the text ends, and how
    many bytes either part has.
    """

    def __init__(self, joined: bytes, bounds: np.ndarray, q: np.ndarray, d: np.ndarray, own: np.ndarray, hot: np.ndarray, owners: int):
        n, before = len(q), PLACES - 1
        buf = np.frombuffer(bytes(before) + joined + bytes(SPAN), np.uint8)
        keys = np.zeros((n, -(-WIDTH // 8) * 8), np.uint8)
        right, left = np.minimum(bounds[d + 1] - q, SPAN), np.minimum(q - bounds[d], before)
        for lo in range(0, n, 1 << 16):  # bounds the memory of the gathered places
            c = slice(lo, lo + (1 << 16))
            to, back = np.arange(SPAN), np.arange(before)
            keys[c, :SPAN] = np.where(to < right[c, None], buf[q[c, None] + before + to], 0)
            keys[c, SPAN : SPAN + before] = np.where(back < left[c, None], buf[q[c, None] + before - 1 - back], 0)
        keys[:, WIDTH - 2], keys[:, WIDTH - 1] = right, left
        if hot.any():  # each has two owners
            h = np.flatnonzero(hot)
            after, ahead = keys[h, : SPAN - NEAR], np.concatenate([keys[h, :GRAM], keys[h, SPAN : SPAN + NEAR + 1]], axis=1)
            own = np.concatenate([own, _dealt(ahead, owners)])
            own[h] = _dealt(after, owners)
            q, d, keys = np.concatenate([q, q[h]]), np.concatenate([d, d[h]]), np.concatenate([keys, keys[h]])
            n = len(q)
        words = keys.view(">u8").astype(np.uint64)
        order = np.lexsort([*words.T[::-1], own])
        words, own = words[order], own[order]
        new = np.ones(n, bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1) | (own[1:] != own[:-1])
        self.q, self.d = q[order], d[order]
        self.first = np.append(np.flatnonzero(new), n)
        self.keys = keys[order[self.first[:-1]], :WIDTH]
        self.own = own[self.first[:-1]]

    def ranges(self) -> list[tuple[int, int, int]]:
        """[(owner, lo, hi)] of the suffixes."""
        cuts = [0, *(np.flatnonzero(self.own[1:] != self.own[:-1]) + 1).tolist(), len(self.own)]
        return [(int(self.own[lo]), lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo]


# Runs

WIDTH = SPAN + PLACES - 1 + 2


def common(x: bytes, y: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which `at` bytes are known."""
    n = min(len(x), len(y))
    if x[at:n] == y[at:n]:
        return n
    while x[at] == y[at]:
        at += 1
    return at


def front_code(keys: np.ndarray, docs: np.ndarray, several: np.ndarray) -> bytes:
    """A sorted run of rows: for each the common prefix with the one before, its least document, whether several have it; then what follows the prefixes."""
    n = len(keys)
    prefix = np.zeros(n, np.int64)
    if n > 1:
        prefix[1:] = (keys[1:] != keys[:-1]).argmax(axis=1)
    rest = keys[np.arange(keys.shape[1]) >= prefix[:, None]]
    return zlib.compress(struct.pack("<II", n, keys.shape[1]) + prefix.astype("u1").tobytes() + several.astype("u1").tobytes() + docs.astype("<i8").tobytes() + rest.tobytes(), 1)


class Run:
    """A front-coded run, read from its start on: the common prefix, least document and whether several have it of each suffix, and the suffixes."""

    def __init__(self, blob: bytes):
        self.data = zlib.decompress(blob)
        self.n, self.width = struct.unpack_from("<II", self.data)
        self.several, self.docs = np.frombuffer(self.data, np.uint8, self.n, 8 + self.n), np.frombuffer(self.data, "<i8", self.n, 8 + 2 * self.n)
        self.rest, self.base, self.keys = 8 + 10 * self.n, 0, [b""]

    def prefix(self, at: int) -> int:
        return self.data[8 + at]

    def key(self, at: int) -> bytes:
        """The suffix at a place, which is not before those asked for last."""
        if at == self.base + len(self.keys) or not at and self.keys == [b""]:
            before, self.base, keys, data = self.keys[-1], at, [], self.data
            for p in data[8 + at : 8 + min(self.n, at + CHUNK)]:
                end = self.rest + self.width - p
                before = before[:p] + data[self.rest : end]
                self.rest = end
                keys.append(before)
            self.keys = keys
        return self.keys[at - self.base]


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """(common prefix with the one before, run, place in it, suffix) of all runs in sorted order.

    A loser tree: node k holds the run that lost there and its common prefix with the run that won, -1 if it is at its
    end. As a winner's path to the root is played again, all prefixes on it are with that winner, the last that was put
    out: of two, the one that has more in common with it comes first, and only a tie is compared, from there on.
    """
    size = 1 << max(0, (len(runs) - 1).bit_length())
    place = [0] * len(runs)
    now = [r.key(0) if r.n else b"" for r in runs]
    lost_run, lost_prefix = [0] * size, [-1] * size

    won = [(i, 0 if i < len(runs) and runs[i].n else -1) for i in range(size)]
    while len(won) > 1:
        up = []
        for k, ((a, la), (b, lb)) in enumerate(zip(won[::2], won[1::2], strict=True)):
            if la >= 0 and la == lb:
                x, y = now[a], now[b]
                p = common(x, y, la)
                a, la, b, lb = (a, la, b, p) if x <= y else (b, lb, a, p)
            elif lb > la:
                a, la, b, lb = b, lb, a, la
            lost_run[len(won) // 2 + k], lost_prefix[len(won) // 2 + k] = b, lb
            up.append((a, la))
        won = up
    best, prefix = won[0]
    while prefix >= 0:
        at = place[best]
        yield prefix, best, at, now[best]
        place[best] = at = at + 1
        if at < runs[best].n:
            now[best], prefix = runs[best].key(at), runs[best].prefix(at)
        else:
            prefix = -1
        k = (size + best) >> 1
        while k:
            lo = lost_prefix[k]
            if lo > prefix:
                lost_run[k], best = best, lost_run[k]
                lost_prefix[k], prefix = prefix, lo
            elif lo == prefix >= 0:
                other = lost_run[k]
                x, y = now[best], now[other]
                p = common(x, y, lo)
                if p == len(x):
                    if other < best:
                        lost_run[k], best = best, other
                elif x[p] > y[p]:
                    lost_run[k], best = best, other
                lost_prefix[k] = p
            k >>= 1


def least_documents(keys: np.ndarray, prefix: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which distinct suffix each is, (distinct, PLACES) least documents) of suffixes in merged order, with all of any anchor.

    Column o is for the string that starts o bytes before the anchor: the least document of all suffixes that have it, where
    the suffix has it.
    """
    new = prefix < WIDTH
    new[:1] = True
    first, which = np.flatnonzero(new), np.cumsum(new) - 1
    u, lcp, own = keys[first], prefix[first].copy(), np.minimum.reduceat(docs, first)
    lcp[:1] = 0
    right, left = u[:, WIDTH - 2].astype(np.int64), u[:, WIDTH - 1].astype(np.int64)
    least = np.repeat(own[:, None], PLACES, axis=1)
    anchor = np.cumsum(lcp < GRAM)
    g = np.flatnonzero(np.bincount(anchor)[anchor] > 1)  # all but the only suffix of an anchor
    if not len(g):
        return which, least
    before = np.zeros((len(g), -(-(PLACES - 1) // 8) * 8), np.uint8)
    before[:, : PLACES - 1] = u[g, SPAN : WIDTH - 2]
    order = np.lexsort(before.view(">u8").astype(np.uint64).T[::-1])
    differ = before[order][1:] != before[order][:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), PLACES)
    by_doc = np.argsort(own[g], kind="stable")
    lcp, right, left, own = lcp[g], right[g], left[g], own[g]
    behind = np.empty(len(g), np.int64)
    for o in range(PLACES):
        behind[order] = np.concatenate([[0], np.cumsum(shared < o)])  # the same o bytes before
        same = np.cumsum(lcp < SPAN - o) * len(g) + behind  # and the same SPAN - o from the anchor on
        use = by_doc[((right >= SPAN - o) & (left >= o))[by_doc]]
        use = use[np.argsort(same[use], kind="stable")]
        if len(use):
            starts = np.flatnonzero(np.concatenate([[True], same[use][1:] != same[use][:-1]]))
            least[g[use], o] = np.repeat(own[use[starts]], np.diff(np.append(starts, len(use))))
    return which, least


_TOLD = np.dtype([("place", "<u4"), ("lo", "u1"), ("hi", "u1"), ("doc", "<i8")])


def answers(runs: list[Run], block: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(run, told): of entries of the merged order, for strings that a smaller document has, or several of the entry's batch, the least document."""
    prefix, run, place = (np.array(c, np.int64) for c in list(zip(*block, strict=True))[:3])
    docs, several = np.empty(len(block), np.int64), np.empty(len(block), bool)
    by_run = np.argsort(run, kind="stable")
    cuts = [0, *(np.flatnonzero(run[by_run][1:] != run[by_run][:-1]) + 1).tolist(), len(run)]
    parts = [by_run[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    for part in parts:
        r = runs[run[part[0]]]
        docs[part], several[part] = r.docs[place[part]], r.several[place[part]] > 0
    keys = np.frombuffer(b"".join([x[3] for x in block]), np.uint8).reshape(len(block), WIDTH)
    which, least = least_documents(keys, prefix, docs)
    o = np.arange(PLACES)
    for part in parts:
        found = least[which[part]]
        has = (o >= SPAN - keys[part, WIDTH - 2, None].astype(np.int64)) & (o <= keys[part, WIDTH - 1, None])
        has &= (found < docs[part, None]) | several[part, None]
        apart = found[:, 1:] != found[:, :-1]
        begin, end = has.copy(), has.copy()
        begin[:, 1:] &= ~has[:, :-1] | apart
        end[:, :-1] &= ~has[:, 1:] | apart
        k, lo = np.nonzero(begin)
        if len(k):
            told = np.empty(len(k), _TOLD)
            told["place"], told["lo"], told["hi"], told["doc"] = place[part][k], lo, np.nonzero(end)[1], found[k, lo]
            yield int(run[part[0]]), told.tobytes()


# Spark stages


def _pack(docs: DataFrame, id_col: str, text_col: str) -> str:
    """The name of (batch, ids, texts) as a table bucketed by batch in the shared folder: joins by batch leave it where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in slices(batch.column(1), BATCH):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(pa.string()))], ["batch", "ids", "texts"])
                n += 1

    spark = docs.sparkSession
    packed = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(freeing(run), "batch long, ids array<long>, texts array<string>")
    name = f"scrollmill_batches_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.write.bucketBy(buckets, "batch").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return name


def _send_anchors(packed: DataFrame, owners: int) -> DataFrame:
    """(owner, batch, keys, several): six leading bytes of each distinct hash, and a bit if several documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                b = Batch(row["ids"], row["texts"])
                keys = b.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]
                out = [(o, row["batch"], keys[lo:hi].tobytes(), np.packbits(b.several[lo:hi]).tobytes()) for o, lo, hi in b.ranges(owners)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["owner", "batch", "keys", "several"])

    return packed.mapInArrow(freeing(run), "owner int, batch long, keys binary, several binary")


def _by_owner(rows: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for batch in rows:
        for row in batch.to_pylist():
            out.setdefault(row["owner"], []).append(row)
    return out


def _find_shared(sent: DataFrame, owners: int) -> DataFrame:
    """(batch, shared [(owner, two bits for each key it sent)]): keys that several documents have, and those that HOT batches have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, rows in _by_owner(batches).items():
            raw = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, 6)
            keys = np.zeros(len(raw), np.uint64)
            for k in range(6):
                keys = (keys << np.uint64(8)) | raw[:, k]
            sizes = [len(r["keys"]) // 6 for r in rows]
            flags = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)]).astype(bool)
            order = np.argsort(keys)
            first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
            n_batches = np.diff(np.append(first, len(keys)))
            n_batches = np.repeat(n_batches, n_batches)
            hot = np.zeros(len(keys), bool)
            flags[order] |= n_batches > 1
            hot[order] = n_batches >= HOT
            ends = np.cumsum(sizes)
            out = [(r["batch"], owner, np.packbits(flags[e - n : e]).tobytes(), np.packbits(hot[e - n : e]).tobytes()) for r, n, e in zip(rows, sizes, ends.tolist(), strict=True) if flags[e - n : e].any()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["batch", "owner", "bits", "hot"])

    found = sent.repartitionById(owners, F.col("owner")).mapInArrow(freeing(run), "batch long, owner int, bits binary, hot binary")
    return found.groupBy("batch").agg(F.collect_list(F.struct("owner", "bits", "hot")).alias("shared"))


def _send_runs(shared: DataFrame, owners: int) -> DataFrame:
    """(owner, batch, run) of batches (batch, ids, texts, shared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                b = Batch(row["ids"], row["texts"])
                f = b.suffixes({x["owner"]: (x["bits"], x["hot"]) for x in row["shared"]}, owners)
                ids = np.array(b.ids, np.int64)[f.d]
                least, most = (g.reduceat(ids, f.first[:-1]) if len(ids) else ids for g in (np.minimum, np.maximum))
                out = [(owner, row["batch"], front_code(f.keys[lo:hi], least[lo:hi], least[lo:hi] < most[lo:hi])) for owner, lo, hi in f.ranges()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["owner", "batch", "run"])

    return shared.mapInArrow(freeing(run), "owner int, batch long, run binary")


def _blocks(merged: Iterator[tuple[int, int, int, bytes]]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """The merged order in blocks that end with an anchor."""
    block: list[tuple[int, int, int, bytes]] = []
    for entry in merged:
        if entry[0] < GRAM and len(block) >= BLOCK:
            yield block
            block = []
        block.append(entry)
    if block:
        yield block


def _merge_runs(sent: DataFrame, owners: int) -> DataFrame:
    """(batch, least [(owner, told)]): for suffixes with strings that several documents have, their least documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, rows in _by_owner(batches).items():
            told = [bytearray() for _ in rows]
            runs = [Run(x.pop("run")) for x in rows]

            for block in _blocks(merge(runs)):
                for i, t in answers(runs, block):
                    told[i] += t
            out = [(r["batch"], owner, zlib.compress(bytes(t), 1)) for r, t in zip(rows, told, strict=True) if t]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["batch", "owner", "told"])

    found = sent.repartitionById(owners, F.col("owner")).mapInArrow(freeing(run), "batch long, owner int, told binary")
    return found.groupBy("batch").agg(F.collect_list(F.struct("owner", "told")).alias("least"))


def _remove(told: DataFrame, owners: int) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of batches (batch, ids, texts, shared, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                texts = [(t or "").encode() for t in row["texts"]]
                gone = np.zeros(sum(map(len, texts)), bool)
                if row["least"]:
                    b = Batch(row["ids"], row["texts"])
                    least = {x["owner"]: np.frombuffer(zlib.decompress(x["told"]), _TOLD) for x in row["least"]}
                    edge = np.zeros(len(gone) + 1, np.int32)
                    f, ids = b.suffixes({x["owner"]: (x["bits"], x["hot"]) for x in row["shared"]}, owners), np.array(b.ids, np.int64)
                    for owner, start, _ in f.ranges():
                        if owner in least:
                            t = least[owner]
                            k = t["place"].astype(np.int64) + start
                            sizes = f.first[k + 1] - f.first[k]
                            t = np.repeat(t, sizes)
                            at = np.repeat(f.first[k] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                            later = ids[f.d[at]] > t["doc"]
                            q, t = f.q[at[later]], t[later]
                            np.add.at(edge, q - t["hi"].astype(np.int64), 1)
                            np.add.at(edge, q - t["lo"].astype(np.int64) + SPAN, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                n, removed, spans, kept, at = [], [], [], [], 0
                for t in texts:
                    g = gone[at : at + len(t)]
                    at += len(t)
                    n.append(len(t))
                    removed.append(int(g.sum()))
                    spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
                    kept.append(np.frombuffer(t, np.uint8)[~g].tobytes() if removed[-1] else t)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), *(pa.array(c, pa.int64()) for c in (n, removed, spans)), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return told.mapInArrow(freeing(run), "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: (id, n_bytes, n_removed, n_spans, kept binary).

    A byte goes if it lies in a string of SPAN bytes that also starts in a document with a smaller id. Strings are judged
    on the input, overlaps count, and none crosses documents. kept holds the bytes that stay, which need not be whole
    characters. A null text counts as empty; a text of fewer than SPAN bytes stays. Ids are integers; a null id is less
    than all others; rows that repeat an id do not remove from each other. Other columns are not read. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spark = docs.sparkSession
    name = _pack(docs, id_col, text_col)
    packed = spark.table(name)
    shared = cut(_find_shared(_send_anchors(packed, owners), owners), "shared")
    least = cut(_merge_runs(_send_runs(packed.join(shared, "batch"), owners), owners), "least")
    out = cut(_remove(packed.join(shared, "batch", "left").join(least, "batch", "left"), owners), "kept")
    spark.sql(f"DROP TABLE {name}")
    return out


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
