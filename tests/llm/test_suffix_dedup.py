import hashlib
import random

import numpy as np
import pytest

from scrollmill.llm import suffix_dedup as s


def brute(rows):
    where = {}
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - s.SPAN + 1):
            w = b[i : i + s.SPAN]
            where[w] = min(where.get(w, r[0]), r[0])
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - s.SPAN + 1):
            if where[b[i : i + s.SPAN]] < r[0]:
                gone[i : i + s.SPAN] = b"\1" * s.SPAN
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((r[0], len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(docs):
    return sorted((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in s.remove_repeats(docs).collect())


@pytest.mark.parametrize(("batch", "hot"), [(1_000_000, 1000), (3000, 1000), (3000, 2)])
def test_removed_bytes_agree_with_brute_force(corpus, batch, hot, monkeypatch):
    monkeypatch.setattr(s, "BATCH", batch)
    monkeypatch.setattr(s, "BLOCK", 50 if hot == 2 else 1 << 15)
    monkeypatch.setattr(s, "HOT", hot)
    docs, rows = corpus
    assert run(docs) == brute(rows)


@pytest.mark.parametrize("hot", [1000, 3])
def test_periodic_texts_and_matches_at_the_limit(spark, hot, monkeypatch):
    monkeypatch.setattr(s, "BATCH", 400)
    monkeypatch.setattr(s, "HOT", hot)
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(52))
    rows = [(k, "".join(rng.choice("xyz ") for _ in range(30)) + shared[: 47 + k % 6] + "".join(rng.choice("xyz ") for _ in range(30))) for k in range(40)]
    rows += [(100 + k, ("ab" * 40 + "c") * (k % 4) + "a" * (45 + k)) for k in range(12)] + [(5, "z" * 200), (-3, "z" * 120), (2**40, "ü" * 90), (2**40 + 1, "ü" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert run(docs) == brute(rows)


def test_no_rows_and_null_ids(spark, no_rows):
    assert s.remove_repeats(no_rows).count() == 0
    docs = spark.createDataFrame([(None, "q" * 60), (1, "q" * 70)], "doc_id long, text string")
    assert {r["id"]: r["n_removed"] for r in s.remove_repeats(docs).collect()} == {None: 0, 1: 70}


def coded(keys, doc=0):
    rows = np.array([list(k) for k in keys], np.uint8).reshape(len(keys), len(keys[0]) if keys else 9)
    return s.front_code(rows, np.full(len(keys), doc), np.zeros(len(keys), bool))


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_merge_is_sorted_with_true_prefixes(chunk, monkeypatch):
    monkeypatch.setattr(s, "CHUNK", chunk)
    rng = random.Random(1)
    runs, every = [], []
    for i in range(7):
        keys = sorted({"".join(rng.choice("ab") for _ in range(9)).encode() for _ in range(rng.choice([0, 3, 20]))})
        runs.append(coded(keys, i))
        every += [(k, i, n) for n, k in enumerate(keys)]
    runs = [s.Run(r) for r in runs]
    got = list(s.merge(runs))
    assert [(x[3], x[1], x[2]) for x in got] == sorted(every)
    assert all(runs[x[1]].docs[x[2]] == x[1] for x in got)
    before = b""
    for prefix, _, _, key in got:
        assert prefix == s.common(before, key)
        before = key


def test_known_prefixes_are_not_compared_again(monkeypatch):
    seen = []
    plain = s.common
    runs = [coded([b"p" * 60 + bytes([97 + k, c]) for c in range(97, 110)], k) for k in range(4)]
    monkeypatch.setattr(s, "common", lambda x, y, at=0: seen.append(at) or plain(x, y, at))
    list(s.merge([s.Run(r) for r in runs]))
    assert sum(at < 60 for at in seen) <= 4  # only while the tree is first filled


def test_least_documents_are_those_of_all_strings():
    """Against a table of all strings around the anchors."""
    rng = random.Random(7)
    rows = []
    for anchor in [b"m" * s.GRAM, b"n" * s.GRAM, b"only one here is of!"]:
        for _ in range(1 if anchor[:1] == b"o" else 40):
            right, left = rng.choice([s.SPAN, 33, 20]), rng.choice([s.PLACES - 1, 12, 0])
            key = (anchor + bytes(rng.choices(b"ab", [9, 1], k=right - s.GRAM))).ljust(s.SPAN, b"\0") + bytes(rng.choices(b"ab", [9, 1], k=left)).ljust(s.PLACES - 1, b"\0")
            rows += [(key + bytes((right, left)), rng.randrange(50))] * rng.choice([1, 1, 2])
    rows.sort()
    rows = [(k, d if i % 2 else rng.randrange(50)) for i, (k, d) in enumerate(rows)]
    prefix = [0, *(s.common(x, y) for (x, _), (y, _) in zip(rows, rows[1:], strict=False))]
    keys = np.frombuffer(b"".join(k for k, _ in rows), np.uint8).reshape(len(rows), s.WIDTH)
    which, least = s.least_documents(keys, np.array(prefix), np.array([d for _, d in rows]))
    have = [[(k[: s.SPAN - o], k[s.SPAN : s.SPAN + o]) if k[-2] >= s.SPAN - o and k[-1] >= o else None for o in range(s.PLACES)] for k, _ in rows]
    for r in range(len(rows)):
        for o in range(s.PLACES):
            if have[r][o]:
                assert least[which[r], o] == min(d for (_, d), h in zip(rows, have, strict=True) if h[o] == have[r][o])


def test_each_string_has_an_anchor_that_depends_on_it_alone():
    rng = np.random.default_rng(3)
    a, b = rng.integers(97, 101, 300).astype(np.uint8).tobytes(), rng.integers(97, 101, 90).astype(np.uint8).tobytes()
    _, _, at, _ = s.anchors([a, b + a[100:200] + b])
    first, second = {x for x in at.tolist() if x < 300}, {x - 300 for x in at.tolist() if x >= 300}
    for i in range(100, 151):
        inside = {x - i for x in first if i <= x <= i + s.PLACES - 1}
        assert inside & {x - (i - 10) for x in second if i - 10 <= x <= i - 10 + s.PLACES - 1}
