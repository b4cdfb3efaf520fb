"""Byte-level BPE encoding and decoding with a given vocabulary.

The pairs of adjacent symbols of a pre-token are the leaves of a segment tree; a leaf holds its pair's merge rank and its
place, an inner node the lesser of its children. The root is thus the leftmost pair of lowest rank. A merge updates
three leaves, each in logarithmic time, until the root says that no pair can be merged.

The trees of all pre-tokens that a slice of texts has and that have not been met before are rows of one array for each
height. A step takes the merge at each row's root and updates the paths above its leaves, level by level. Very long
pre-tokens, of which there are few, have the same tree each by itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from scrollmill.llm.common import freeing, small_batches
from scrollmill.llm.shingles import MULTIPLIER, slices

#: Fixed value: how the vocabulary's pre-tokenizer splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Leaves of the trees that are held in one array.
LEAVES = 1 << 18
#: From this height on a pre-token's tree is worked on alone, in plain numbers: with few rows, steps over arrays cost more.
ALONE = 10
#: Pre-tokens of which the ids are kept, in each of two generations.
KEPT = 300_000


def byte_letters() -> dict[int, str]:
    """The printable letter by which the vocabulary writes each byte: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Ranks:
    """The rank of each pair of ids that can be merged, and the id that the pair becomes, in a hash table with open addressing."""

    def __init__(self, pairs: Sequence[tuple[int, int]], merged: Sequence[int]):
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        bits = max(4, len(keys).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        self.merged, self.none = np.array([*merged, -1], np.int64), len(keys)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.keys[slot] < 0]
            self.at[slot[self.keys[slot] < 0]] = free  # of several the last written holds the slot
            won = np.zeros(len(left), bool)
            mine = self.keys[slot] < 0
            won[mine] = self.at[slot[mine]] == left[mine]
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MULTIPLIER) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; `none` where there is no such merge, or either id is negative."""
        keys = (a << 32) | b
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where((found == keys) & (b >= 0) & (a >= 0), self.at[slot], self.none)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Coder:
    def __init__(self, path: str, kept: int = KEPT):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        merges = list({(vocab[a], vocab[b]): vocab[a + b] for a, b in reversed(spec["model"]["merges"])}.items())[::-1]
        self.ranks = Ranks([p for p, _ in merges], [m for _, m in merges])
        self.rank_of = {p: k for k, (p, _) in enumerate(merges)}
        self.texts = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts |= {i: t.encode() for t, i in special.items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.split = regex.compile(SPLIT)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.kept, self.met, self.before = kept, dict(self.special), {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        height = np.array([max(0, n - 2).bit_length() for n in sizes.tolist()], np.int64)  # 2**height pairs at least
        for h in np.unique(height).tolist():
            rows = np.flatnonzero(height == h)
            if h >= ALONE:
                for k in rows.tolist():
                    out[k] = self._grow_alone(pieces[k])
                continue
            step = LEAVES >> h
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                ids, sums = self._grow([pieces[k] for k in part.tolist()], sizes[part], 1 << h)
                ends = (np.cumsum(sums) * 4).tolist()
                for k, a, b in zip(part.tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[k] = ids[a:b]
        return out

    def _grow(self, pieces: list[bytes], sizes: np.ndarray, wide: int) -> tuple[bytes, np.ndarray]:
        """The ids of all pieces, which have up to wide + 1 bytes, and how many of them each has."""
        n, cols, ranks = len(pieces), wide + 1, self.ranks
        inside = np.arange(cols) < sizes[:, None]
        ids = np.full((n, cols), -1, np.int64)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        none = ranks.none * wide  # more than any leaf that has a merge
        tree = np.empty((n, 2 * wide), np.int64)
        tree[:, wide:] = ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, wide) * wide + np.arange(wide)
        width = wide
        while width > 1:
            np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2], out=tree[:, width // 2 : width])
            width //= 2
        # Flat from here on: row r has symbols from r * cols on, and leaves from r * 2 * wide + wide on. Column cols - 1 has no
        # leaf, and neighbours beyond a row's ends lie in places of their own, of which the ids are -1.
        ids, tree = np.append(ids.ravel(), -1), tree.ravel()
        end = n * cols
        place = np.arange(end).reshape(n, cols)
        after, before = place + 1, place - 1
        after[np.arange(n), sizes - 1] = end
        before[:, 0] = end
        after, before = np.append(after.ravel(), end), np.append(before.ravel(), end)
        rows = np.arange(n)
        levels = wide.bit_length() - 1
        while len(rows):
            top = tree[rows * 2 * wide + 1]
            going = top < none
            rows, top = rows[going], top[going]
            if not len(rows):
                break
            start, rank = rows * cols, top // wide
            col = top - rank * wide
            i = start + col
            j = after[i]
            k = after[j]
            g = before[i]
            ids[i], ids[j] = ranks.merged[rank], -1
            after[i] = k
            before[k] = np.where(k < end, i, end)
            # Leaves of i, of j, which is gone, and of the symbol before i; where there is none, i's is written again.
            here = ranks(ids[i], ids[k]) * wide + col
            has = g < end
            col_g = np.where(has, g - start, col)
            there = np.where(has, ranks(ids[g], ids[i]) * wide + col_g, here)
            col_j = j - start
            last = col_j == wide  # no leaf
            leaf = np.concatenate([col, np.where(last, col, col_j), col_g]) + wide
            value = np.concatenate([here, np.where(last, here, none + col_j), there])
            base = np.concatenate([rows, rows, rows]) * (2 * wide)
            tree[base + leaf] = value
            for _ in range(levels):
                leaf >>= 1
                child = base + 2 * leaf
                tree[base + leaf] = np.minimum(tree[child], tree[child + 1])
        ids = ids[:-1].reshape(n, cols)
        left = ids >= 0
        return ids[left].astype("<u4").tobytes(), left.sum(axis=1)

    def _grow_alone(self, piece: bytes) -> bytes:
        """What _grow does, for one piece of any length."""
        ids, none, to = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), self.ranks.none, self.ranks.merged
        n = len(ids)
        size = 1 << (n - 2).bit_length()
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        least = np.full(2 * size, none * n, np.int64)
        least[size : size + n - 1] = np.where(first < none, first * n + np.arange(n - 1), none * n)
        while size > 1:
            least[size // 2 : size] = np.minimum(least[size : 2 * size : 2], least[size + 1 : 2 * size : 2])
            size //= 2
        size, tree, rank = 1 << (n - 2).bit_length(), least.tolist(), self.rank_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree[1]) < none * n:
            i = top % n
            j = after[i]
            ids[i], ids[j] = int(to[top // n]), -1
            after[i] = k = after[j]
            changed = [(i, rank.get((ids[i], ids[k]), none) if k < n else none)]
            if j < n - 1:
                changed.append((j, none))
            if k < n:
                before[k] = i
            if (g := before[i]) >= 0:
                changed.append((g, rank.get((ids[g], ids[i]), none)))
            for place, value in changed:
                at, value = size + place, value * n + place if value < none else none * n
                while at and tree[at] != value:
                    tree[at] = value
                    at >>= 1
                    a, b = (tree[2 * at], tree[2 * at + 1]) if at else (0, 0)
                    value = a if a < b else b
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special token is a piece of its own, which no pre-token equals."""
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self.split.findall(text, at, m.start())
            out.append(m[0])
            at = m.end()
        return out + self.split.findall(text[at:]) if at else self.split.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers. Special tokens in a text get their own ids."""
        parts = [self.pieces(t) for t in texts]
        if len(self.met) > self.kept:  # what has not been met since is forgotten
            self.met, self.before = dict(self.special), self.met
        new = set().union(*parts).difference(self.met)
        self.met |= {p: self.before[p] for p in new if p in self.before}
        new = [p for p in new if p not in self.met]
        self.met |= zip(new, self.merge([p.encode() for p in new]), strict=True)
        get = self.met.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder a process and vocabulary, so that what it has met serves the next tasks too."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): the ids of each whole text as little-endian 32-bit integers; a null or empty text has none.

    Rows are independent of each other, whatever their ids; other columns are not read. No rows: no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                ids = c.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary())], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(freeing(run), f"id {kind}, ids binary")


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(id, text) of a table (id, ids) as encode_texts makes it; null ids decode to an empty text."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder(vocabulary).decode
        for batch in batches:
            texts = [decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(freeing(run), f"id {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each whole text: encoded, and decoded from those ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = coder(vocabulary), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                n, a, b = [], [], []
                for ids in c.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]):
                    n.append(len(ids) // 4)
                    a.append(sha(ids))
                    b.append(sha(c.decode(ids).encode()))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(freeing(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, default_vocabulary()).withColumnRenamed("id", "doc_id")
