"""What must be the same before and after: messages, roles, calls, and that results belong to calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmill.sources.sessions import from_json_messages


def _issue(rows: DataFrame, rule: str, text) -> DataFrame:
    return rows.select("session_id", F.lit(rule).alias("rule"), text.alias("issue"))


def call_refs(messages: DataFrame) -> DataFrame:
    """(session_id, call_id) of calls that have an id and a name."""
    calls = from_json_messages(messages.select("session_id", "msg_idx", "raw_json")).calls
    return calls.where("coalesce(call_id, '') <> '' and coalesce(tool_name, '') <> ''").select("session_id", "call_id")


def changed_roles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Messages (session_id, msg_idx, role, new) whose role is another one after, or that are only on one side."""
    both = before.select("session_id", "msg_idx", "role").join(after.select("session_id", "msg_idx", F.col("role").alias("new")), ["session_id", "msg_idx"], "full")
    return both.where(~F.col("role").eqNullSafe(F.col("new")))


def check_integrity(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session_id, rule, issue) of all that is wrong with messages after (session_id, msg_idx, role, tool_call_id, raw_json); no rows if nothing is."""
    invalid = _issue(after.where(F.try_parse_json("raw_json").isNull()), "json", F.concat(F.lit("Message is no valid JSON: "), F.col("msg_idx").cast("string")))
    n = before.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).join(after.groupBy("session_id").agg(F.count(F.lit(1)).alias("m")), "session_id", "full").fillna(0)
    count = _issue(n.where("n <> m"), "message_count", F.format_string("Message count changed: %d -> %d", F.col("n"), F.col("m")))
    role = _issue(changed_roles(before, after).select("session_id").distinct(), "role_sequence", F.lit("Role sequence changed"))
    calls, new_calls = call_refs(before), call_refs(after)
    c = calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).join(new_calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("m")), "session_id", "full").fillna(0)
    call_count = _issue(c.where("n <> m"), "call_count", F.format_string("Tool call count changed: %d -> %d", F.col("n"), F.col("m")))
    key = ["session_id", "call_id"]
    results, new_results = (x.where("role = 'toolResult'").select("session_id", F.col("tool_call_id").alias("call_id")).distinct() for x in (before, after))
    calls, new_calls = calls.distinct(), new_calls.distinct()
    lost = _issue(calls.join(results, key, "left_semi").join(new_results, key, "left_anti"), "result_lost", F.concat(F.lit("Tool call without its result: "), F.col("call_id")))
    new = _issue(new_calls.join(calls, key, "left_anti"), "call_new", F.concat(F.lit("Tool call that was not there before: "), F.col("call_id")))
    orphan = _issue(new_results.join(new_calls, key, "left_anti"), "result_orphan", F.concat(F.lit("Tool result without a call: "), F.coalesce("call_id", F.lit("null"))))
    out = invalid
    for x in (count, role, call_count, lost, new, orphan):
        out = out.unionByName(x)
    return out
