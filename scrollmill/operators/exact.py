"""Exact repeats, of whole tool results and of single blocks. The first holder in order stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrollmill.functions.blocks import fingerprint, message_keys, n_bytes
from scrollmill.functions.text import text_block_len
from scrollmill.schema import BlockOptions, ExactOptions, Transcript


def _marked(columns: list[str]) -> list[Column]:
    """The columns of blocks joined with markers: a row with a `marker` is a text block that holds it."""
    marker = F.col("marker")
    new = {"src_idx": F.lit(None).cast("int"), "block_type": F.lit("text"), "text": marker, "data": F.lit(None).cast("string"), "mime_type": F.lit(None).cast("string"), "json_bytes": text_block_len(marker)}
    return [F.when(marker.isNull(), F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in columns]


def replace_messages(blocks: DataFrame, markers: DataFrame) -> DataFrame:
    """Blocks with those of the messages in markers (session_id, msg_idx, marker) replaced by one text block each."""
    joined = blocks.join(markers, ["session_id", "msg_idx"], "left")
    return joined.where(F.col("marker").isNull() | (F.col("block_idx") == 0)).select(*_marked(blocks.columns))


def exact_markers(blocks: DataFrame, options: ExactOptions = ExactOptions()) -> DataFrame:
    """(session_id, msg_idx, first_msg_idx, marker) of tool results that repeat an earlier one of min_length bytes at least."""
    keyed = message_keys(blocks).where(F.col("bytes") >= options.min_length)
    same = Window.partitionBy("session_id", "key").orderBy("msg_idx")
    ranked = keyed.select(
        "session_id", "msg_idx", "bytes", F.row_number().over(same).alias("n"), F.first("tool_call_id").over(same).alias("first_id"), F.first("msg_idx").over(same).alias("first_msg_idx")
    )
    marker = F.concat(F.lit("[identical to output of toolCallId "), F.coalesce("first_id", F.lit("undefined")), F.lit(", "), F.col("bytes").cast("string"), F.lit(" bytes elided]"))
    return ranked.where("n > 1").select("session_id", "msg_idx", "first_msg_idx", marker.alias("marker"))


def exact_dedupe(t: Transcript, options: ExactOptions = ExactOptions()) -> Transcript:
    return t.with_(blocks=replace_messages(t.blocks, exact_markers(t.blocks, options).drop("first_msg_idx")))


def block_dedupe(t: Transcript, options: BlockOptions = BlockOptions()) -> Transcript:
    """Blocks of min_block_length bytes at least that repeat an earlier one, of the same message too, become markers."""
    narrow = t.blocks.select("session_id", "msg_idx", "block_idx", "tool_call_id", "block_type", n_bytes().alias("bytes"), F.sha2(fingerprint(), 256).alias("key"))
    narrow = narrow.where(F.col("key").isNotNull() & (F.col("bytes") >= options.min_block_length))
    same = Window.partitionBy("session_id", "key").orderBy("msg_idx", "block_idx")
    ranked = narrow.select("session_id", "msg_idx", "block_idx", "block_type", "bytes", F.row_number().over(same).alias("n"), F.first("tool_call_id").over(same).alias("first_id")).where("n > 1")
    marker = F.concat(F.lit("[identical "), F.col("block_type"), F.lit(" block to output of toolCallId "), F.coalesce("first_id", F.lit("undefined")), F.lit(", "), F.col("bytes").cast("string"), F.lit(" bytes elided]"))
    joined = t.blocks.join(ranked.select("session_id", "msg_idx", "block_idx", marker.alias("marker")), ["session_id", "msg_idx", "block_idx"], "left")
    return t.with_(blocks=joined.select(*_marked(t.blocks.columns)))
