"""Long repeated substrings of a session's tool results become markers; a sequential scan of each session."""

from __future__ import annotations

import time
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmill.functions.blocks import is_text
from scrollmill.functions.text import json_string_len, utf8_len
from scrollmill.operators.shingle_parts import texts_by_parts
from scrollmill.schema import ShingleOptions, Transcript
from scrollmill.storage import cut

#: The polynomial hash by which shingles are found. Shingles that collide are told apart by their text.
BASE, MOD = 257, 1_000_000_007
#: Bytes of the longest session that one task scans whole.
MOST = 16 << 20


def units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` code units at each place, put together from windows of powers of two."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    part, width, have, out = codes.astype(np.int64) % MOD, 1, 0, np.zeros(n, np.int64)
    while size >> width.bit_length() - 1:
        if size & width:  # the next `width` units follow those that out has
            out = (out * pow(BASE, width, MOD) + part[have : have + n]) % MOD
            have += width
        if width * 2 <= size:
            part = (part[:-width] * pow(BASE, width, MOD) + part[width:]) % MOD
        width *= 2
    return out


def repeated_places(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Of each array the places whose hash occurs more than once in all of them; no other place can match or be matched."""
    every = np.sort(np.concatenate(hashes)) if hashes else np.zeros(0, np.int64)
    again = np.unique(every[1:][every[1:] == every[:-1]])
    if not len(again):
        return [np.zeros(0, np.int64) for _ in hashes]
    return [np.flatnonzero(again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h) for h in hashes]


class Session:
    """What a session's tool results have said so far, joined without a border, and where each shingle was first seen."""

    def __init__(self, options: ShingleOptions):
        self.size, self.least = options.shingle, max(options.min_repeat, options.shingle)
        self.said = np.zeros(1 << 12, np.uint16)
        self.n = 0
        self.first: dict[int, tuple[int, str]] = {}
        #: Further shingles of a hash that `first` has for another one.
        self.more: dict[int, list[tuple[int, str]]] = {}

    def _say(self, codes: np.ndarray) -> None:
        while self.n + len(codes) > len(self.said):
            self.said = np.concatenate([self.said, np.zeros_like(self.said)])
        self.said[self.n : self.n + len(codes)] = codes
        self.n += len(codes)

    def skip(self, text: str) -> None:
        """A text that stays as it is and is not looked up either."""
        self._say(units(text))

    def take(self, text: str, ref: str, hashes: np.ndarray | None = None, places: np.ndarray | None = None) -> tuple[str, list[tuple[int, int, int]]]:
        """The text with markers, and (start, length, place of the earlier occurrence) of what each replaces.

        hashes: its window_hashes; places: those of them that may occur elsewhere, all unless given.
        """
        codes, start = units(text), self.n
        self._say(codes)
        hashes = window_hashes(codes, self.size) if hashes is None else hashes
        places = np.arange(len(hashes)) if places is None else places
        found = list(zip(places.tolist(), hashes[places].tolist(), strict=True))
        out, spans, k, copied = [], [], 0, 0
        while k < len(found):
            at, own = found[k]
            seen = self.first.get(own)
            match = self._match(codes, start, at, seen[0]) if seen else 0
            if seen and not match:  # another shingle of this hash
                seen, match = next(((x, n) for x in self.more.get(own, ()) if (n := self._match(codes, start, at, x[0]))), (seen, 0))
                if not match:
                    self.more.setdefault(own, []).append((start + at, ref))
            if match:
                lo, hi = at, at + match
                # A span never parts the halves of one character.
                lo += 0xDC00 <= codes[lo] <= 0xDFFF and lo > 0 and 0xD800 <= codes[lo - 1] <= 0xDBFF
                hi -= 0xD800 <= codes[hi - 1] <= 0xDBFF and hi < len(codes) and 0xDC00 <= codes[hi] <= 0xDFFF
                gone = codes[lo:hi].tobytes().decode("utf-16-le", "surrogatepass") if hi - lo >= self.least else ""
                marker = f"[repeated substring, {len(gone.encode('utf-8', 'replace'))} bytes, see earlier occurrence in toolCallId {seen[1]}]"
                if gone and len(units(marker)) < hi - lo:
                    out += [codes[copied:lo].tobytes().decode("utf-16-le", "surrogatepass"), marker]
                    spans.append((lo, hi - lo, seen[0] + lo - at))
                    # What follows the match goes on, from its end; a half left over by snapping stays as text.
                    copied, k = hi, bisect_left(found, (at + match,), k)
                    continue
            self.first.setdefault(own, (start + at, ref))
            k += 1
        if not spans:
            return text, []
        out.append(codes[copied:].tobytes().decode("utf-16-le", "surrogatepass"))
        return "".join(out), spans

    def _match(self, codes: np.ndarray, start: int, at: int, other: int) -> int:
        """How many code units from `at` on are those from `other` on; 0 unless a whole shingle is."""
        if other >= start + at:
            return 0
        most, have, step = len(codes) - at, 0, self.size
        while have < most:
            n = min(step, most - have)
            same = self.said[other + have : other + have + n] == codes[at + have : at + have + n]
            if not same.all():
                have += int(same.argmin())
                break
            have, step = have + n, step * 2
        return have if have >= self.size else 0


def _scan(rows: pd.DataFrame, options: ShingleOptions) -> list[tuple]:
    """(session_id, msg_idx, block_idx, new_text, spans) of a session's texts that change."""
    session, out = Session(options), []
    rows = rows.sort_values(["msg_idx", "block_idx"])
    hashes = [np.zeros(0, np.int64) if p else window_hashes(units(t), options.shingle) for t, p in zip(rows.text, rows.protected, strict=True)]
    for r, h, places in zip(rows.itertuples(), hashes, repeated_places(hashes), strict=True):
        if r.protected:
            session.skip(r.text)
            continue
        new, spans = session.take(r.text, r.ref, h, places)
        if spans:
            out.append((r.session_id, r.msg_idx, r.block_idx, new, [{"at": a, "n": n, "source": s} for a, n, s in spans]))
    return out


def shingle_texts(texts: DataFrame, options: ShingleOptions, most: int = MOST) -> DataFrame:
    """(session_id, msg_idx, block_idx, new_text, spans) of texts (session_id, msg_idx, block_idx, text, ref, protected) that change.

    Each step depends on all before it; sessions are independent. A session of `most` bytes or less is scanned by one task,
    of a longer one shingle_parts finds the repeats over all tasks, and one task walks over these without the texts. Only
    places whose hash the session has twice are walked, the rest is passed over in whole arrays.
    """

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_scan(rows, options), columns=["session_id", "msg_idx", "block_idx", "new_text", "spans"])

    def whole(of: DataFrame) -> DataFrame:
        return of.groupBy("session_id").applyInPandas(scan, "session_id string, msg_idx int, block_idx int, new_text string, spans array<struct<at:int,n:int,source:long>>")

    long = cut(texts.groupBy("session_id").agg(F.sum(utf8_len(F.col("text"))).alias("n")).where(F.col("n") > most).select("session_id"), "long-sessions")
    if long.isEmpty():
        return whole(texts)
    # A place that a session has twice names no text, so that the order of such a session is that of its rows.
    twice = texts.join(F.broadcast(long), "session_id", "left_semi").groupBy("session_id", "msg_idx", "block_idx").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or msg_idx is null or block_idx is null")
    long = F.broadcast(cut(long.join(twice.select("session_id").distinct(), "session_id", "left_anti"), "long-sessions"))
    return whole(texts.join(long, "session_id", "left_anti")).unionByName(texts_by_parts(texts.join(long, "session_id", "left_semi"), options))


def shingle_latency(t: Transcript, options: ShingleOptions = ShingleOptions()) -> DataFrame:
    """(session_id, bytes, ms): how long the scan of each session takes by itself, where it runs."""

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        start = time.perf_counter()
        _scan(rows, options)
        return pd.DataFrame([(rows.session_id.iloc[0], int(rows.text.map(lambda x: len(x.encode("utf-8", "replace"))).sum()), (time.perf_counter() - start) * 1000)], columns=["session_id", "bytes", "ms"])

    return _texts(t, options).groupBy("session_id").applyInPandas(scan, "session_id string, bytes long, ms double")


def protected_messages(messages: DataFrame, window: int) -> DataFrame:
    """(session_id, from_idx): messages from there on are a session's last `window`, of any role."""
    return messages.groupBy("session_id").agg((F.count(F.lit(1)) - window).alias("from_idx"))


def _texts(t: Transcript, options: ShingleOptions) -> DataFrame:
    texts = t.blocks.where(is_text()).select("session_id", "msg_idx", "block_idx", "text", F.coalesce("tool_call_id", F.lit("undefined")).alias("ref"))
    if options.recent_window > 0:
        return texts.join(protected_messages(t.messages, options.recent_window), "session_id").withColumn("protected", F.col("msg_idx") >= F.col("from_idx")).drop("from_idx")
    return texts.withColumn("protected", F.lit(False))


def shingle_dedupe(t: Transcript, options: ShingleOptions = ShingleOptions()) -> Transcript:
    new = shingle_texts(_texts(t, options), options).drop("spans")
    out = t.blocks.join(new, ["session_id", "msg_idx", "block_idx"], "left")
    grown = F.when(F.col("new_text").isNull(), F.lit(0)).otherwise(json_string_len(F.col("new_text")) - json_string_len(F.col("text")))
    out = out.withColumns({"json_bytes": F.col("json_bytes") + grown, "text": F.coalesce("new_text", "text")})
    return t.with_(blocks=out.select(*t.blocks.columns))


def repeated_shingles(texts: DataFrame, size: int, step: int) -> DataFrame:
    """(session_id, shingle, n, first_msg, first_at): shingles at every step-th place that occur more than once; no Python."""
    places = texts.where(F.length("text") >= size).select("session_id", "msg_idx", "text", F.explode(F.sequence(F.lit(0), F.length("text") - size, F.lit(step))).alias("at"))
    cut = places.select("session_id", "msg_idx", "at", F.substring("text", F.col("at") + 1, F.lit(size)).alias("shingle"))
    grouped = cut.groupBy("session_id", "shingle").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("msg_idx", "at")).alias("first"))
    return grouped.where("n > 1").select("session_id", "shingle", "n", F.col("first.msg_idx").alias("first_msg"), F.col("first.at").alias("first_at"))
