import random

import numpy as np
import pytest

from scrollmill.llm import quality as q


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(700):
        good = rng.random() < 0.7
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 40))]
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        source = rng.choice(["s1", "s2"]) if good or rng.random() < 0.2 else "s9"
        rows.append((i, text, "en", source))
        if i % 3 == 0:
            labels.append((i, int(good)))
    rows += [(900, None, None, None), (901, " ", "en", ""), (902, "long " * 30000, "en", "s1"), (3, rows[3][1], "en", rows[3][3])]
    labels += [(5000, 1), (0, None), (None, 1)]
    truth = {i: "!!" not in (t or "") for i, t, *_ in rows}
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int"), truth


def test_scores_tell_good_from_bad(tables):
    docs, labels, truth = tables
    got = q.score(docs, q.learn(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    unlabelled = [r for r in got if r["id"] < 700 and r["id"] % 3]
    assert sum((r["score"] >= 0.5) == truth[r["id"]] for r in unlabelled) / len(unlabelled) > 0.97
    assert all(r["kept"] == (r["score"] >= 0.5) for r in got)


def test_reruns_agree(tables):
    docs, labels, _ = tables
    a, b = q.learn(docs, labels), q.learn(docs.repartition(7), labels.repartition(3))
    assert np.allclose(a.text, b.text) and np.allclose(a.mixed, b.mixed)


def test_a_view_learns_from_the_other():
    """The text view has few labels of its own; what the metadata view is sure of teaches it more words."""
    rng = np.random.default_rng(5)
    n = 1200
    y = rng.integers(0, 2, n)
    meta = np.stack([y == 1, y == 0], axis=1).astype(np.float32)
    text = np.zeros((n, 40), np.float32)
    text[np.arange(n), rng.integers(0, 20, n) + 20 * y] = 1
    known = np.where(np.arange(n) < 24, y, -1)
    kept = (np.arange(n) % 4 == 0) & (np.arange(n) < 24)
    alone, taught = (q.co_train(text, meta, known, kept, rounds=r) for r in (0, 4))
    right = [((q.logits(text, s.text) > 0) == (y == 1)).mean() for s in (alone, taught)]
    assert taught.passed > 400 and right[1] > 0.98 > right[0]


def test_nothing_to_learn_from(spark, no_rows, tables):
    docs, labels, _ = tables
    s = q.learn(docs, labels.limit(0))
    assert {r["score"] for r in q.score(docs, s).collect()} == {0.5}
    assert q.score(no_rows, q.learn(no_rows, labels)).count() == 0


def test_all_unlabelled_rows_take_part(spark):
    """More sure rows than a view once passed on; scans of a table find what the same rows at hand give."""
    rng = random.Random(8)
    rows, labels = [], {}
    for i in range(3000):
        good = rng.random() < 0.5
        rows.append((i if i % 50 else None, " ".join(f"{'good' if good else 'bad'}{rng.randrange(60)}" for _ in range(rng.randrange(8))), "en", "s1" if good else "s9"))
        if i % 20 == 1:
            labels[i] = int(good)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    s = q.learn(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    assert s.passed > 4500
    rows.sort(key=lambda r: q.zlib.crc32(f"{r[0]}".encode()))
    xt = np.stack([q.text_features(t).astype("<f2").astype(np.float32) for _, t, *_ in rows])
    xm = np.stack([q.meta_features(source, lang, len(t), 1) for _, t, lang, source in rows])
    y = np.array([labels.get(r[0], -1) for r in rows])
    kept = np.array([q.zlib.crc32(f"{r[0]}".encode()) % 4 == 0 for r in rows]) & (y >= 0)
    want = q.co_train(xt, xm, y, kept)
    assert want.passed == s.passed and np.allclose(want.text, s.text, atol=1e-6) and np.allclose(want.meta, s.meta, atol=1e-4)
