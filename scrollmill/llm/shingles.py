"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text each; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased, words parted by ASCII white space.

    Fewer than `width` words make one shingle; without words, or for a null text, there is none.
    """
    lists = pc.ascii_split_whitespace(pa.array(texts.to_pylist(), pa.large_string()).fill_null(""))
    words, bounds = pc.ascii_lower(lists.values), np.asarray(lists.offsets).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not full.all():  # what lies before a leading and after a trailing space
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        words = words.filter(pa.array(full))
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    w = known[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.uint64)
    h = np.zeros(0, np.uint64)
    if len(w) >= width:
        h = w[: len(w) - width + 1].copy()
        for k in range(1, width):
            h = h * MULTIPLIER + w[k : len(w) - width + 1 + k]
        h = mix64(h)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(w[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
