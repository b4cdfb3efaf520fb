"""Sessions that grow: each micro-batch recomputes the sessions it touches.

Later messages change earlier ones (a write makes a read stale, the window of protected messages moves), so appending
would be wrong; the result of a session is replaced as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from scrollmill.plans.compress import compress, messages_of
from scrollmill.schema import DEFAULTS, Options
from scrollmill.sources.sessions import from_lines

LINES = "session_id string, line_no long, line string"


def recompute(lines: DataFrame, batch: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Messages of the sessions that batch touches, from all their lines."""
    touched = batch.select("session_id").distinct()
    t = from_lines(lines.join(touched, "session_id", "left_semi"))
    return messages_of(compress(t, options), t)


def stream_sessions(source: DataFrame, log: str, emit: Callable[[DataFrame, int], None], checkpoint: str, options: Options = DEFAULTS) -> StreamingQuery:
    """Follow a stream of session lines. Each batch is added to a log (a Parquet folder, by batch), so that a batch that
    is run again replaces itself, and emit(messages, batch number) gets the touched sessions' new messages."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("session_id", "line_no", "line").write.mode("overwrite").parquet(f"{log}/batch={number}")
        emit(recompute(spark.read.schema(LINES).parquet(log), spark.read.schema(LINES).parquet(f"{log}/batch={number}"), options), number)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
