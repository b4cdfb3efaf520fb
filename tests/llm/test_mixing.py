import hashlib
import re
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from scrollmill.llm.mixing import mix, plan_mix


def brute(rows):
    """Targets by filling up, one excess after the other, in exact fractions."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    share, full = Fraction(3 * sum(total.values()), 2), set()
    while True:
        rest = [s for s in names if s not in full]
        left = share - sum(2 * total[s] for s in full)
        target = {s: Fraction(2 * total[s]) for s in full} | {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if target[s] >= 2 * total[s]}
        if not over:
            return size, total, target
        full |= over


def test_plan_agrees_with_brute_force(corpus):
    docs, rows = corpus
    size, total, target = brute(rows)
    got = plan_mix(docs).select("doc_id", "source", "__mix.*").collect()
    assert len(got) == len(rows)
    by_id = {r[0]: (r, n) for r, n in zip(rows, size, strict=True)}
    for g in got:
        r, n = by_id[g["doc_id"]]
        assert (g["size"], g["source_size"]) == (n, total[r[3]])
        assert abs(g["target"] - float(target[r[3]])) < 1e-6
        rate = g["target"] / g["source_size"] if g["source_size"] else 0
        u = int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        assert g["copies"] == int(rate) + (u < rate - int(rate)) <= 2


def test_mix_emits_copies_and_keeps_columns(corpus):
    docs, rows = corpus
    docs = docs.withColumn("size", F.lit("kept")).withColumn("count", F.lit(1))
    copies = sum(r["copies"] for r in plan_mix(docs).select("__mix.copies").collect())
    out = mix(docs)
    assert out.columns == docs.columns
    assert out.count() == copies
    assert {r["size"] for r in out.collect()} == {"kept"}


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 30 == 1, "b").otherwise("c").alias("source"))
    got = plan_mix(docs).groupBy("source").agg(F.sum(F.col("__mix.size") * F.col("__mix.copies")).alias("taken"), F.first("__mix.target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.05 for r in got)


def test_no_rows_and_no_words(spark, no_rows):
    assert plan_mix(no_rows).count() == 0
    silent = spark.createDataFrame([(1, None, None), (2, " ", None)], "doc_id long, text string, source string")
    assert [tuple(r["__mix"]) for r in plan_mix(silent).collect()] == [(0, 0, 0.0, 0)] * 2


def test_many_sources_are_ranked_by_code_point(spark):
    rows = [(i, "w " * (i % 7 + 1), None if i == 5 else f"s{i * 37 % 101}{'ß' * (i % 2)}", None, None) for i in range(150)]
    docs = spark.createDataFrame([(i, t, s) for i, t, s, *_ in rows], "doc_id long, text string, source string").repartition(5)
    _, total, target = brute([(i, t, None, s) for i, t, s, *_ in rows])
    for r in plan_mix(docs).select("source", "__mix.*").collect():
        assert r["source_size"] == total[r["source"]] and abs(r["target"] - float(target[r["source"]])) < 1e-6
