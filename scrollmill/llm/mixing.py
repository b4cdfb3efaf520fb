"""Mixing sources to target weights.

Words are summed per source, a target per source gives its repetition rate, and a document is emitted
floor(rate) times plus once more if its hash falls below the fraction that is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrollmill.llm.common import cut, join_split, n_words, packed_row, unit_hash


def source_targets(sizes: DataFrame, weights: Sequence[int], share_percent: int, cap: int) -> DataFrame:
    """Add `weight` and `target` to the table (src, source_size), one row a source; other columns stay, no rows give none.

    The k-th source by code point (null last) weighs weights[k mod len]. Together they get share_percent of all
    words, split by weight; a source gets at most cap times its own words and the others share what is over.
    The table grows with the number of sources: it is sorted and ranked in parallel and stays distributed.
    """
    order = F.col("src").asc_nulls_last()
    ranged = cut(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    counts = sorted(tuple(r) for r in ranged.groupBy("part").count().collect())  # one a partition
    first = [(part, sum(n for p, n in counts if p < part)) for part, _ in counts]
    first = sizes.sparkSession.createDataFrame(first, "part int, first long")
    nth = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), (nth % len(weights)).cast("int")).cast("long")
    ranked = cut(ranged.join(F.broadcast(first), "part").withColumn("weight", weight).drop("part", "first"), "mix-sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    share = total * share_percent / 100
    limit = F.col("source_size") * cap
    level_num, level_den = share, None
    while True:  # the level only rises, so a source that is at its cap stays there
        full = F.lit(False) if level_den is None else limit * level_den <= F.col("weight") * level_num
        got = ranked.agg(F.sum(F.when(full, limit).otherwise(0)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w")).first()
        new = (share - (got["held"] or 0), got["w"] or 0)
        if not new[1] or new == (level_num, level_den):
            break
        level_num, level_den = new
    even = F.lit(level_num) * F.col("weight") / F.lit(float(level_den or 1))
    return ranked.withColumn("target", F.least(limit.cast("double"), even))


def _planned(docs: DataFrame, weights: Sequence[int], share_percent: int, cap: int, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, plan): the rows of docs and what plan_mix adds to them."""
    key = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    sized = docs.select(packed_row(docs).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), key.alias("key"), n_words(F.col(text_col)).alias("size"))
    sizes = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(cut(sizes, "mix-sizes"), weights, share_percent, cap)
    targets = targets.select(F.struct(F.col("src").isNull().alias("none"), F.coalesce("src", F.lit("")).alias("name")).alias("key"), "source_size", "target", "n")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (unit_hash(seed, F.col("id")) < rate - F.floor(rate)).cast("long")
    joined = join_split(sized.drop("src"), cut(targets, "mix-targets"), ["key"], "n", ["id"])
    return joined.select("row", F.struct("size", "source_size", "target", copies.alias("copies")).alias("plan"))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share_percent: int = 150,
    cap: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs with one more column `__mix`, which replaces one of that name: struct(size, source_size, target, copies).

    size: words of the text, 0 for a null or empty one. Null is a source of its own, apart from ''. A source
    without words gets target 0 and no copies. Rows that repeat a document are documents of their own that share
    their hash, as null ids do. An empty table gives an empty table; other columns are kept as they are, whatever their names.
    """
    planned = _planned(docs, weights, share_percent, cap, seed, id_col, text_col, source_col)
    return planned.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "__mix"], F.col("plan").alias("__mix"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share_percent: int = 150,
    cap: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: each row of docs as often as its plan says, with the columns of docs, whatever their names.

    Null and empty texts, null sources, null and repeated ids, and an empty table are treated as in plan_mix; a row of a
    source without words is not emitted.
    """
    planned = _planned(docs, weights, share_percent, cap, seed, id_col, text_col, source_col).where("plan.copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("plan.copies"))).alias("copy")).select("row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    planned = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return planned.select("doc_id", "__mix.size", "__mix.source_size", "__mix.target", (F.col("__mix.size") * F.col("__mix.copies")).alias("taken"))


#: The level at which filling stops is found by trying each source as the last full one.
ORACLE_OP1 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, 2 * source_size AS lim,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY lim / w, source NULLS LAST) AS k FROM r),
c AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
             (SELECT sum(source_size) FROM s) * 1.5 AS share FROM o),
l AS (SELECT CAST(share - held AS DOUBLE) AS num, CAST(rest AS DOUBLE) AS den FROM c WHERE lim * rest > w * (share - held) ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(CAST(lim AS DOUBLE), coalesce((SELECT num FROM l) * w / (SELECT den FROM l), CAST(lim AS DOUBLE))) AS target FROM r),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < rate - floor(rate)
                                      THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM p
"""
