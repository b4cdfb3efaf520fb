"""Reports on statistics (session_id, pass_no, pass, bytes_before, bytes_after, hits)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrollmill.functions.text import token_estimate

NO_RUN = "No context compression has run yet in this session."


def saved_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, (1 - after / before) * 100).otherwise(F.lit(0.0))


def session_rows(stats: DataFrame, messages: DataFrame, issues: DataFrame) -> DataFrame:
    """(session_id, messages, bytes and tokens before and after, ratio, ok) by session."""
    ends = stats.groupBy("session_id").agg(F.min_by("bytes_before", "pass_no").alias("bytes_before"), F.max_by("bytes_after", "pass_no").alias("bytes_after"))
    n = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))
    bad = issues.select("session_id").distinct().withColumn("ok", F.lit(False))
    before, after = F.col("bytes_before"), F.col("bytes_after")
    rows = ends.join(n, "session_id").join(bad, "session_id", "left")
    return rows.select("session_id", "messages", "bytes_before", "bytes_after", saved_percent(before, after).alias("ratio"), token_estimate(before).alias("tokens_before"), token_estimate(after).alias("tokens_after"), F.coalesce("ok", F.lit(True)).alias("ok"))


def pass_totals(stats: DataFrame) -> DataFrame:
    """(pass_no, pass, bytes_before, bytes_after, hits, ratio) over all sessions."""
    sums = stats.groupBy("pass_no", "pass").agg(*[F.sum(c).alias(c) for c in ("bytes_before", "bytes_after", "hits")])
    return sums.withColumn("ratio", saved_percent(F.col("bytes_before"), F.col("bytes_after")))


def grand_total(rows: DataFrame) -> DataFrame:
    """One row of sums over session_rows."""
    sums = rows.agg(F.count(F.lit(1)).alias("sessions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "bytes_before", "bytes_after")])
    before, after = F.col("bytes_before"), F.col("bytes_after")
    return sums.select("*", saved_percent(before, after).alias("ratio"), token_estimate(before).alias("tokens_before"), token_estimate(after).alias("tokens_after"))


def _percent(before: int, after: int) -> str:
    return f"{(1 - after / before) * 100:.2f}" if before > 0 else "0.00"


def stats_report(stats: DataFrame | None, session_id: str) -> str:
    """A session's statistics as lines of text."""
    rows = [] if stats is None else stats.where(F.col("session_id") == session_id).orderBy("pass_no").collect()
    if not rows:
        return NO_RUN
    before, after = rows[0]["bytes_before"], rows[-1]["bytes_after"]
    lines = [f"Context compression: {before} -> {after} bytes (-{_percent(before, after)}%)"]
    lines += [f"  {r['pass']}: {r['bytes_before']} -> {r['bytes_after']} bytes (-{_percent(r['bytes_before'], r['bytes_after'])}%, {r['hits']} message(s) touched)" for r in rows]
    return "\n".join(lines)


def latency_summary(rows: DataFrame) -> DataFrame:
    """(sessions, bytes, total_ms, min_ms, max_ms, avg_ms, ms_per_kb) of times by session (bytes, ms)."""
    sums = rows.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_ms"), *[f("ms").alias(f"{f.__name__}_ms") for f in (F.min, F.max, F.avg)])
    return sums.withColumn("ms_per_kb", F.when(F.col("bytes") > 0, F.col("total_ms") / (F.col("bytes") / 1024)).otherwise(0.0))


def timed(runs: dict[str, Callable[[], object]], n_bytes: int) -> list[dict]:
    """Wall-clock milliseconds of each run, in all and per KB."""
    out = []
    for name, f in runs.items():
        start = time.perf_counter()
        f()
        ms = (time.perf_counter() - start) * 1000
        out.append({"name": name, "total_ms": ms, "ms_per_kb": ms / (n_bytes / 1024) if n_bytes else 0.0})
    return out
