"""Exact dedup over an extendible-hash index kept in the shared folder; DataFrame functions only.

The key of a text is a 64-bit hash. A directory maps a key's leading bits to its bucket: a bucket with more keys than
its capacity is split by one bit more, and the directory doubles as often as the deepest bucket needs. Rows go to the
owner of their bucket, a range of keys, by way of the directory. The owner chains the different texts of one key, which
it tells apart by their bytes, and the index holds a link for each. A row then looks up its bucket in the directory and
its link in the bucket.

The text of a key that one row alone has is never moved: there is nothing to compare it with. Copies of a key that very
many rows have are combined before they go to the owner, and its links are read in as many places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrollmill.llm.common import HOT_SHARE, cut, drop_rows, join_split

#: Keys of a bucket.
CAPACITY = 512
#: Rows of a key that are dealt with in one place.
SPLIT = 1024
#: Bits by which keys are counted beyond those that buckets of even size would need. A bucket that is overfull even then
#: stays so, which 64-bit hashes do not bring about.
SPARE = 4


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _cell(key: Column, depth: int) -> Column:
    """The key's leading bits."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """((cell, bucket, depth), global depth) for distinct keys (h); cells are the keys' leading bits, as many as the global depth.

    A bucket of depth d has the keys with d leading bits in common; it is named by its first cell. It is there if its keys
    fit, or no more bits are counted, and those of the bucket that it was split from did not. The table grows with the
    keys by the capacity and stays distributed; only its depth is known to the driver.
    """
    n = keys.count()
    deepest = max(0, math.ceil(math.log2(max(1, n) / capacity)) + SPARE) if n > capacity else 0
    deepest = min(deepest, 62)
    spark = keys.sparkSession
    fine = keys.groupBy(_cell(F.col("h"), deepest).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    upper = fine.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(deepest)), lambda d: F.struct(d.alias("depth"), F.expr("cell").alias("cell")))).alias("x"))
    prefix = F.expr(f"shiftright(x.cell, {deepest} - x.depth)")
    nodes = upper.groupBy(F.col("x.depth").alias("depth"), prefix.alias("prefix")).agg(F.sum("n").alias("n"))
    full = nodes.where((F.col("n") > capacity) & (F.col("depth") < deepest))
    halves = F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)
    made = full.select((F.col("depth") + 1).alias("depth"), F.explode(halves).alias("prefix"))
    root = spark.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))
    buckets = root.unionByName(made).join(full.select("depth", "prefix"), ["depth", "prefix"], "left_anti")
    buckets = cut(buckets, "buckets")
    depth = buckets.agg(F.max("depth")).first()[0]
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    cells = F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - depth)") - 1)
    return cut(buckets.select(F.explode(cells).alias("cell"), first.alias("bucket"), "depth"), "directory"), depth


def _links(texts: DataFrame, keys: DataFrame, cells: DataFrame, depth: int, split: int) -> DataFrame:
    """(bucket, h, text_sha256, keep_id, group_size): a link for each text of the keys that several rows have.

    texts: (id, h, text); keys: (h, n). All of a bucket's rows meet in its owner's task, where equal means equal bytes.
    """
    own = [F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")]

    def placed(these: DataFrame) -> DataFrame:
        """The texts of these keys, with their buckets."""
        return join_split(texts, these.withColumn("cell", _cell(F.col("h"), depth)).join(cells.select("cell", "bucket"), "cell").select("h", "n", "bucket"), ["h"], "n", ["id"], split)

    split = max(split, -(-(keys.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE))
    some = placed(keys.where((F.col("n") > 1) & (F.col("n") <= split))).select("bucket", "h", "text", *own)
    hot = keys.where(F.col("n") > split)
    if not hot.isEmpty():
        share = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / split))
        many = placed(hot).withColumn("share", share).groupBy("bucket", "h", "text", "share").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        some = some.unionByName(many.drop("share"))
    chains = some.repartition("bucket").groupBy("bucket", "h", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return chains.select("bucket", "h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")


def build_index(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, split: int = SPLIT) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows, index, directory, global depth).

    rows: (id, h, text_sha256), one for each of docs; index: (bucket, h, text_sha256, keep_id, group_size), one for each text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), _key(text).alias("h"), text.alias("text"))
    rows = cut(texts.select("id", "h", F.sha2("text", 256).alias("text_sha256")), "rows")
    keys = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"), F.min("text_sha256").alias("text_sha256")), "keys")
    cells, depth = directory(keys.select("h"), capacity)
    alone = keys.where("n = 1").withColumn("cell", _cell(F.col("h"), depth)).join(cells.select("cell", "bucket"), "cell")
    alone = alone.select("bucket", "h", "text_sha256", "keep_id", F.lit(1).cast("long").alias("group_size"))
    index = cut(alone.unionByName(_links(texts, keys.select("h", "n"), cells, depth, split)), "index")
    return rows, index, cells, depth


def look_up(rows: DataFrame, index: DataFrame, cells: DataFrame, depth: int, split: int = SPLIT) -> DataFrame:
    """rows (id, h, text_sha256) with keep_id and group_size of their links, which the directory leads to; links of hot texts lie in several places."""
    found = rows.withColumn("cell", _cell(F.col("h"), depth)).join(cells.select("cell", "bucket"), "cell").drop("cell")
    return join_split(found, index, ["bucket", "h", "text_sha256"], "group_size", ["id"], split)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, split: int = SPLIT) -> DataFrame:
    """One row for each of docs: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; null ids count as the smallest. A null text counts as empty, and
    empty texts are copies of each other. Texts are compared whole, with no change. Rows that repeat an id and its text
    count one by one in group_size and share their verdict. Other columns of docs are not looked at. No rows: no rows.
    """
    found = look_up(*build_index(docs, id_col, text_col, capacity, split), split)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, split: int = SPLIT) -> DataFrame:
    """One row of docs for each text, with all its columns, whatever their names: that with the largest id.

    Null ids count as the smallest, a null text as empty. Of rows that repeat an id and its text the one whose other
    columns hash least stays. No rows: no rows.
    """
    found = look_up(*build_index(docs, id_col, text_col, capacity, split), split)
    verdicts = found.select("id", F.unhex("text_sha256").alias("sha"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))
    return drop_rows(docs, id_col, text_col, cut(verdicts, "verdicts"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return mark_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP4 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
