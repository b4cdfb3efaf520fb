import hashlib
import random

import numpy as np
import pytest

from scrollmill.llm.bpe import Coder, decode_ids, default_vocabulary, encode_texts, round_trip

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = default_vocabulary()
    return Coder(path), tokenizers.Tokenizer.from_file(path)


def ids(coder, text):
    return np.frombuffer(coder.encode([text])[0], "<u4").tolist()


def decoded(coder, text):
    return coder.decode(coder.encode([text])[0])


def test_ids_are_those_of_the_library(both):
    coder, library = both
    rng = random.Random(3)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", " \n\n  x", "x  ", "it's I'LL don't", "\x1c\x1d a\x85b\xa0c", "a" * 5000, "😀a😀", "​﻿ x"]
    texts += ["".join(rng.choice("ab .'\n\t9<|>é😀中Z") for _ in range(rng.randrange(80))) for _ in range(2000)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(coder, t) == want, t[:60]
        assert decoded(coder, t) == library.decode(want, skip_special_tokens=False) == t


def test_all_kinds_of_characters(both):
    coder, library = both
    for lo in range(0, 0x3000, 64):
        t = " ".join(f"a{chr(c)}{chr(c)}1" for c in range(lo, lo + 64))
        assert ids(coder, t) == library.encode(t, add_special_tokens=False).ids


def test_pre_tokens_of_every_length(both):
    """Trees of every height, in arrays and alone."""
    coder, library = both
    rng = random.Random(8)
    pieces = ["".join(rng.choice("abeinrst") for _ in range(n)) for n in [*range(1, 140), 255, 256, 257, 258, 1023, 1024, 1025, 1026, 1027, 2049, 2050, 5000]]
    want = [library.encode(p, add_special_tokens=False).ids for p in pieces]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.merge([p.encode() for p in pieces])] == want
    assert [np.frombuffer(coder._grow_alone(p.encode()), "<u4").tolist() for p in pieces[2:]] == want[2:]
    assert coder.merge([]) == []


def test_leftmost_of_the_lowest_ranks_is_merged_first(both):
    coder, library = both
    for t in ("aaaaaaa", "ssssssssssss", "ababababab", "  " * 9 + "x"):
        assert ids(coder, t) == library.encode(t, add_special_tokens=False).ids


def test_cache_is_bounded(both):
    coder, _ = both
    texts = ["one two three four", "five six seven", "one two three", "eight"]
    want = coder.encode(texts)
    coder.kept, coder.met, coder.before = 3, dict(coder.special), {}
    for _ in range(3):
        for t, w in zip(texts, want, strict=True):
            assert coder.encode([t]) == [w]
            assert len(coder.met) <= 3 + len(coder.special) + 4 and len(coder.before) <= 8
    coder.kept = 300_000


def test_queries_round_trip(corpus, no_rows, both):
    docs, rows = corpus
    _, library = both
    path = default_vocabulary()
    text = {r[0]: r[1] or "" for r in rows}
    for r in round_trip(docs, path).collect():
        want = library.encode(text[r["id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["id"]].encode()).hexdigest()
    back = decode_ids(encode_texts(docs, path), path).collect()
    assert sorted((r["id"], r["text"]) for r in back) == sorted((r[0], r[1] or "") for r in rows)
    assert round_trip(no_rows, path).count() == 0
