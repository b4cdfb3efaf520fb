"""What a content block is, how long it is, and what tells it from others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrollmill.functions.text import utf8_len, utf16_len


def is_text() -> Column:
    return F.col("block_type") == "text"


def fingerprint() -> Column:
    """The block's content with its type; null for unknown types."""
    return F.when(is_text(), F.concat(F.lit("text:"), F.col("text"))).when(
        F.col("block_type") == "image", F.concat(F.lit("image:"), F.coalesce("mime_type", F.lit("")), F.lit(":"), F.coalesce("data", F.lit("")))
    )


def n_bytes() -> Column:
    """UTF-8 bytes of the text or of the encoded image; 0 for unknown types."""
    return F.coalesce(F.when(is_text(), utf8_len(F.col("text"))).when(F.col("block_type") == "image", utf8_len(F.col("data"))), F.lit(0).cast("long"))


def shown() -> Column:
    """The block as it is shown: its text, or the kind and size of an image."""
    image = F.concat(F.lit("[image:"), F.coalesce("mime_type", F.lit("")), F.lit(":"), utf16_len(F.coalesce("data", F.lit(""))).cast("string"), F.lit("]"))
    return F.when(is_text(), F.col("text")).when(F.col("block_type") == "image", image).otherwise("")


def per_message(blocks: DataFrame) -> DataFrame:
    """(session_id, msg_idx, tool_call_id, fingerprint, shown, bytes, json_bytes) of each tool result with blocks, its blocks in order."""
    one = F.struct("block_idx", F.coalesce(fingerprint(), F.lit("")).alias("f"), F.coalesce(shown(), F.lit("")).alias("s"))
    grouped = blocks.groupBy("session_id", "msg_idx").agg(
        F.first("tool_call_id").alias("tool_call_id"), F.array_sort(F.collect_list(one)).alias("all"), F.sum(n_bytes()).alias("bytes"), F.sum("json_bytes").alias("json"), F.count(F.lit(1)).alias("n")
    )
    return grouped.select(
        "session_id",
        "msg_idx",
        "tool_call_id",
        F.array_join(F.transform("all", lambda b: b["f"]), "\n\0\n").alias("fingerprint"),
        F.array_join(F.transform("all", lambda b: b["s"]), "\n").alias("shown"),
        "bytes",
        (F.col("json") + F.col("n") + 1).alias("json_bytes"),
    )


def message_keys(blocks: DataFrame) -> DataFrame:
    """(session_id, msg_idx, tool_call_id, bytes, key): a digest of each tool result's fingerprint, and its bytes.

    Blocks are hashed before they are grouped; only results of several blocks, whose fingerprint runs over all of them, are
    put together as text.
    """
    key = ["session_id", "msg_idx"]
    narrow = blocks.select(*key, "tool_call_id", n_bytes().alias("bytes"), F.sha2(F.coalesce(fingerprint(), F.lit("")), 256).alias("key"))
    grouped = narrow.groupBy(*key).agg(F.first("tool_call_id").alias("tool_call_id"), F.sum("bytes").alias("bytes"), F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    several = per_message(blocks.join(grouped.where("n > 1").select(*key), key, "left_semi"))
    one = grouped.where("n = 1").drop("n")
    return one.unionByName(several.select(*key, "tool_call_id", "bytes", F.sha2("fingerprint", 256).alias("key")))
