"""File reads that a later write, followed by another read of the same path, has made stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrollmill.functions.blocks import shown
from scrollmill.functions.fileops import file_ops
from scrollmill.functions.text import utf16_len
from scrollmill.operators.exact import exact_markers, replace_messages
from scrollmill.schema import ExactOptions, Transcript


def call_ops(calls: DataFrame) -> DataFrame:
    """(session_id, call_id, ops): the last call of each id that has operations."""
    ops = calls.select("session_id", "msg_idx", "block_idx", "call_id", file_ops(F.col("tool_name"), F.col("args_json")).alias("ops")).where(F.size("ops") > 0)
    return ops.groupBy("session_id", "call_id").agg(F.max_by("ops", F.struct("msg_idx", "block_idx")).alias("ops"))


def stale_reads(events: DataFrame) -> DataFrame:
    """(session_id, idx) of reads in events (session_id, path, idx, kind) with a write after them and before the path's last read."""
    path = Window.partitionBy("session_id", "path")
    later = path.orderBy("idx").rangeBetween(1, Window.unboundedFollowing)
    reads, writes = (F.when(F.col("kind") == k, F.col("idx")) for k in ("read", "write"))
    seen = events.select("session_id", "idx", "kind", F.max(reads).over(path).alias("last_read"), F.min(writes).over(later).alias("next_write"))
    stale = (F.col("kind") == "read") & (F.col("idx") != F.col("last_read")) & (F.col("next_write") < F.col("last_read"))
    return seen.where(stale).select("session_id", "idx").distinct()


def superseded_reads(t: Transcript, safe_refs: DataFrame | None = None) -> Transcript:
    """Results of stale reads become markers; one stale path is enough. safe_refs: (session_id, msg_idx) of results to leave."""
    results = t.messages.where("role = 'toolResult'").select("session_id", "msg_idx", F.col("tool_call_id").alias("call_id"))
    known = results.join(call_ops(t.calls), ["session_id", "call_id"])
    events = known.select("session_id", F.col("msg_idx").alias("idx"), F.explode("ops").alias("op")).select("session_id", "idx", "op.path", "op.kind")
    stale = stale_reads(events).withColumnRenamed("idx", "msg_idx")
    if safe_refs is not None:
        stale = stale.join(safe_refs, ["session_id", "msg_idx"], "left_anti")
    one = (F.size("ops") == 1) & (F.get("ops", F.lit(0))["kind"] == "read")
    named = F.when(one, F.concat(F.lit("file ("), F.get("ops", F.lit(0))["path"], F.lit(")"))).otherwise("file")
    told = known.join(stale, ["session_id", "msg_idx"]).select("session_id", "msg_idx", named.alias("file"))
    # Of results of several blocks the line feeds between them count too.
    size = utf16_len(F.coalesce(shown(), F.lit("")))
    chars = t.blocks.select("session_id", "msg_idx", size.alias("size")).groupBy("session_id", "msg_idx").agg((F.sum("size") + F.count(F.lit(1)) - 1).alias("chars"))
    marker = F.concat(F.lit("[stale: "), F.col("file"), F.lit(" was modified after this read, see later read for current content — "), F.col("chars").cast("string"), F.lit(" chars elided]"))
    markers = told.join(chars, ["session_id", "msg_idx"]).select("session_id", "msg_idx", marker.alias("marker"))
    return t.with_(blocks=replace_messages(t.blocks, markers))


def referenced(t: Transcript, options: ExactOptions) -> DataFrame:
    """(session_id, msg_idx) of results that exact duplicates refer to."""
    return exact_markers(t.blocks, options).select("session_id", F.col("first_msg_idx").alias("msg_idx")).distinct()
