"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.storage import cut, shared_dir

__all__ = ["WORD", "cut", "drop_rows", "free_memory", "freeing", "n_words", "join_split", "packed_row", "shared_dir", "small_batches", "text_digest", "unit_hash"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes that are handed to Python at once, unless the session says otherwise.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":  # Spark's own default
        spark.conf.set(key, f"{BATCH_BYTES}b")


def free_memory() -> None:
    """Give back what Python, Arrow and the C library hold but do not use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with its memory given back at the end, as workers stay for other tasks and hold it beside them."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            free_memory()

    return wrapped


def n_words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: str, key: Column) -> Column:
    """A fraction in [0, 1) that depends on seed and key alone (52 bits of an MD5 sum)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def packed_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


#: A key is hot from this share of all rows on, so that the list of hot keys is short whatever the input.
HOT_SHARE = 4096


def join_split(rows: DataFrame, entries: DataFrame, key: list[str], n_col: str, by: list[str], least: int = 1024, known: tuple[int | None, int | None] | None = None) -> DataFrame:
    """Inner join of rows with entries, which have one row a key and say in n_col how many of rows have it.

    Entries of hot keys are copied, and the rows of such a key dealt over the copies by a hash of `by`, so that no task has
    more than about `least` rows of one key, or a HOT_SHARE-th of all. Neither has a column `__share`. known: the sum and the
    maximum of n_col, if they have been looked up.
    """
    total, top = known or entries.agg(F.sum(n_col), F.max(n_col)).first()
    most = max(least, -(-(total or 0) // HOT_SHARE))
    if (top or 0) <= most:
        return rows.join(entries, key)
    hot = entries.where(F.col(n_col) > most).select(*key, F.ceil(F.col(n_col) / most).alias("__share"))
    found = rows.join(F.broadcast(hot), key, "left")  # fewer than HOT_SHARE keys
    found = found.withColumn("__share", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__share")), F.lit(0).cast("long")))
    copies = entries.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n_col) / most) - 1)))
    return found.join(copies, [*key, "__share"]).drop("__share")


def text_digest(text: Column) -> Column:
    """What tells whole texts apart where they are not compared byte by byte; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def drop_rows(docs: DataFrame, id_col: str, text_col: str, verdicts: DataFrame) -> DataFrame:
    """docs without the rows that verdicts (id, sha, kept) drop, with all their columns, whatever these are named.

    verdicts has a row for each of docs. Of rows that repeat an id and its text and are kept, that whose other columns hash
    least stays.
    """
    gone = verdicts.where("not kept").select("id", "sha").distinct()
    packed = docs.select(packed_row(docs).alias("row"), F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("sha"))

    def same(x: DataFrame) -> Column:
        return packed["id"].eqNullSafe(x["id"]) & (packed["sha"] == x["sha"])

    stay = packed.join(gone, same(gone), "left_anti")
    twins = verdicts.where("kept").groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "sha")
    if twins.isEmpty():
        return stay.select("row.*")
    plain = [F.col("row")[f.name] for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    one = packed.join(twins, same(twins), "left_semi").groupBy("id", "sha").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return stay.join(twins, same(twins), "left_anti").select("row.*").unionByName(one.select("row.*"))
