import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from scrollmill.llm import common
from scrollmill.llm import components as c
from scrollmill.llm import minhash_dedup as m
from scrollmill.llm.components import components
from scrollmill.llm.shingles import shingle_sets


def brute(rows, percent, width=5):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(lower))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(s), least[find(i)], r[0] == least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("percent", "block"), [(85, 1024), (80, 7)])
def test_components_agree_with_brute_force(corpus, percent, block, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", block)
    docs, rows = corpus
    assert sorted(map(tuple, m.near_components(docs, percent=percent).collect())) == brute(rows, percent)


def test_a_group_whose_hub_is_far_from_most(spark, monkeypatch):
    """A chain of texts, each near the next alone, and pairs apart from it: only the last step can find them all."""
    monkeypatch.setattr(m, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    rows, own = [], list(base)
    for k in range(40):
        own[rng.randrange(100)] = f"c{k}"
        rows.append((rng.randrange(10**9), " ".join(own)))
    for k in range(40):
        far = list(base)
        for i in rng.sample(range(100), 8):
            far[i] = f"d{k}{i}"
        rows += [(rng.randrange(10**9), " ".join(far)), (rng.randrange(10**9), " ".join([*far, "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, m.near_components(docs, percent=85).collect())) == brute(rows, 85)


def test_repeated_and_null_ids_lose_no_link(spark):
    base, other = " ".join(f"b{i}" for i in range(60)), " ".join(f"o{i}" for i in range(60))
    rows = [(1, base), (1, other), (5, base + " x"), (6, other + " y"), (None, base + " z q"), (None, "lone words here and there"), (7, "lone words here and there"), (None, "n m"), (None, "n m"), (None, None), (8, "")]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in m.near_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()]
    want = [(1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (None, 1, False), (None, 7, False), (7, 7, True), (None, None, True), (None, None, True), (None, None, True), (8, 8, True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_row_of_each_component_stays(spark):
    base, other = " ".join(f"b{i}" for i in range(60)), " ".join(f"o{i}" for i in range(60))
    rows = [(1, base, 1), (1, other, 1), (5, base + " x", 2), (6, other + " y", 3), (None, base + " z q", 4), (None, "n m", 5), (None, "n m", 6), (None, None, 7), (3, "x y", 8), (3, "x y", 8), (4, "", 9), (9, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha int").withColumn("row", F.lit(1)).withColumn("component", F.lit(2))
    out = m.drop_near_copies(docs, percent=85)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:3]) for r in out.collect())
    assert got == [(0, ""), (0, "n m"), (1, "b0 "), (1, "o0 "), (3, "x y"), (4, ""), (9, "")]


def test_pairs_near_the_threshold_are_found(spark):
    """Pairs on either side of the threshold: all links among 600 pairs are found, and nothing else."""
    rng = random.Random(7)
    rows = []
    for k in range(600):
        base = [f"p{k}w{i}" for i in range(rng.choice((40, 120, 300)))]
        near = list(base)
        cut = rng.choice((1, 2, 3, 5)) * len(base) // 100 + 1
        for i in rng.sample(range(len(base)), cut):
            near[i] = "q"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    want = brute_pairs(rows, 85)
    got = {r["doc_id"]: r["component_id"] for r in m.near_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    found = {k for k in range(600) if got[2 * k + 1] == 2 * k}
    close = {k for k, s in want.items() if 0.85 <= s < 0.90}
    assert len(close) >= 30 and found == {k for k, s in want.items() if s >= 0.85}


def brute_pairs(rows, percent, width=5):
    out = {}
    for (i, x), (_, y) in zip(rows[::2], rows[1::2], strict=True):
        a, b = ({tuple(t.split()[k : k + width]) for k in range(len(t.split()) - width + 1)} for t in (x, y))
        out[i // 2] = len(a & b) / len(a | b)
    return out


def test_hubs_are_dealt_over_tasks(spark, monkeypatch):
    join = m.join_split
    split = lambda *args, known=None: join(*args, least=4, known=known)
    monkeypatch.setattr(common, "HOT_SHARE", 2)
    monkeypatch.setattr(m, "join_split", split)
    monkeypatch.setattr(c, "join_split", split)
    links = [(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(40, 60)] + [(200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys([*range(60), *range(140, 160)], 0), 200: 200, 201: 200}
    rng = random.Random(11)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for k in range(50):
        own = list(base)
        for _ in range(k % 5):
            own[rng.randrange(80)] = f"y{rng.randrange(5)}"
        rows.append((k, " ".join(own)))
    rows += [(60 + k, " ".join(base)) for k in range(30)]
    assert sorted(map(tuple, m.near_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect())) == brute(rows, 85)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 600).astype(np.uint64)
    for share in (0.0, 0.5, 0.9):
        n = int(600 * share)
        a, b = (np.unique(np.concatenate([common[:n], rng.integers(0, 2**63, 600 - n).astype(np.uint64)])) for _ in range(2))
        true = n / (1200 - n)
        s = m.minima([a, b])
        assert abs(m.estimate(m.pack(s[:1]), m.pack(s[1:]))[0, 0] - true) < 0.15
    assert 0.6 < m.floor_of(0.85) < 0.8


def test_shingles_of_slices_are_those_of_the_whole():
    texts = pa.array(["A b c d e f", None, " ", "a  B\tc d e f ", "x y", "X y", "é ü ß ö ä"])
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 0, 0, 2, 1, 1, 1]
    assert (sets[0] == sets[3]).all() and (sets[4] == sets[5]).all()
    assert all((a == b).all() for a, b in zip(sets[3:], shingle_sets(texts.slice(3)), strict=True))


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (5, 4), (4, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(100, 161), 100), 4: 4, 5: 4}


def test_no_rows(no_rows):
    assert m.near_components(no_rows).count() == 0 and m.drop_near_copies(no_rows).count() == 0


def test_a_pair_is_told_of_in_the_first_band_that_it_shares(spark):
    """The pipeline's last finding: near copies were told of in each band, 32 at most."""
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(i, " ".join([*words[: 390 - i], f"own{i}", *words[391 - i :]])) for i in range(30)], "doc_id long, text string")
    reps = m.sign(docs, "doc_id", "text", 5).select("id", "bands", "packed")
    members = reps.select("id", F.posexplode("bands").alias("band", "key")).withColumn("label", F.col("id"))
    buckets = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("most"), F.min("id").alias("hub"), F.lit(1).cast("long").alias("n_most")).where("n > 1")
    opened = members.join(buckets, ["band", "key"])
    found = m._plausible(opened, reps, 85)
    rows = found.collect()
    assert {r["id"] for r in rows} - {None} == set(range(30))
    assert {x for r in rows for x in (r["a"], r["b"])} - {None} == set(range(30))
    assert sum(r["id"] is not None for r in rows) < opened.count() / 2
