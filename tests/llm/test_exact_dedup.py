import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scrollmill.llm import exact_dedup
from scrollmill.llm.exact_dedup import build_index, directory, drop_copies, look_up, mark_copies


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return sorted((r[0], max(g), len(g), r[0] == max(g), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows for g in [groups[r[1] or ""]])


@pytest.mark.parametrize(("capacity", "split"), [(1, 1024), (10, 4), (8192, 1)])
def test_marks_agree_with_brute_force(corpus, capacity, split):
    docs, rows = corpus
    got = mark_copies(docs.withColumn("h", F.lit(1)).withColumn("keep_id", F.lit(2)).withColumn("bucket", F.lit(3)), capacity=capacity, split=split)
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("split", [1024, 2])
def test_texts_whose_keys_collide_are_told_apart(corpus, monkeypatch, split):
    monkeypatch.setattr(exact_dedup, "_key", lambda text: (F.xxhash64(text) % 3).cast("long"))
    docs, rows = corpus
    assert sorted(map(tuple, mark_copies(docs, split=split).collect())) == brute(rows)


def test_rows_are_found_by_way_of_the_directory(corpus):
    docs, rows = corpus
    found = build_index(docs, "doc_id", "text", capacity=10)
    cells, depth = found[2], found[3]
    assert depth >= 3 and cells.count() == 2**depth
    per_bucket = found[1].groupBy("bucket").count()
    assert per_bucket.count() > 8 and per_bucket.agg(F.max("count")).first()[0] <= 10
    one = cells.first()["bucket"]
    less = cells.where(F.col("bucket") != one)
    moved = cells.withColumn("bucket", F.when(F.col("bucket") == one, one + 1).otherwise(F.col("bucket")))
    for wrong in (less, moved):
        assert look_up(found[0], found[1], wrong, depth).count() < len(rows)
    assert look_up(*found).count() == len(rows)


def test_drop_keeps_columns_and_one_of_equal_rows(corpus, spark):
    docs, rows = corpus
    kept = sorted({r[0] for r in brute(rows) if r[3]})
    out = drop_copies(docs.withColumn("group_size", F.lit("x")).withColumn("__keep_id", F.lit(1)).withColumn("sha", F.lit(2)).withColumn("row", F.lit(3)))
    assert out.columns == [*docs.columns, "group_size", "__keep_id", "sha", "row"]
    assert sorted(r["doc_id"] for r in out.collect()) == kept
    twice = spark.createDataFrame([(1, "t", 5), (1, "t", 6), (None, "n", 7), (None, "n", 7), (2, "u", None), (3, None, 8), (4, "", 9)], "doc_id long, text string, more int")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in drop_copies(twice).collect())
    assert got == [(0, "n"), (1, "t"), (2, "u"), (4, "")]


def grown(keys, capacity):
    """The buckets that keys put in one by one bring about: {(depth, leading bits)}."""
    buckets = {(0, 0): []}
    for k in keys:
        d = next(d for d in range(65) if (d, k >> (64 - d)) in buckets)
        buckets[d, k >> (64 - d)].append(k)
        while len(buckets[d, k >> (64 - d)]) > capacity:
            held = buckets.pop((d, k >> (64 - d)))
            d += 1
            p = held[0] >> (65 - d)
            buckets |= {(d, 2 * p): [], (d, 2 * p + 1): []}
            for x in held:
                buckets[d, x >> (64 - d)].append(x)
    return set(buckets)


@pytest.mark.parametrize(("n", "capacity"), [(0, 2), (5, 8), (700, 9), (700, 40)])
def test_directory_is_that_of_keys_put_in_one_by_one(spark, n, capacity):
    keys = spark.range(n).select(F.xxhash64("id").alias("h"))
    want = grown([r["h"] % 2**64 for r in keys.collect()], capacity)
    cells, depth = directory(keys, capacity)
    assert depth == max(d for d, _ in want)
    got = cells.collect()
    assert sorted(r["cell"] for r in got) == list(range(2**depth))
    assert {(r["depth"], r["bucket"] >> (depth - r["depth"])) for r in got} == want
    assert all(r["bucket"] >> (depth - r["depth"]) == r["cell"] >> (depth - r["depth"]) for r in got)


def test_no_rows_and_null_ids(spark, no_rows):
    assert mark_copies(no_rows).count() == 0 and drop_copies(no_rows).count() == 0
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["kept"]) for r in mark_copies(docs).collect()) == [(0, 0, True), (0, 1, False), (1, 1, True)]
