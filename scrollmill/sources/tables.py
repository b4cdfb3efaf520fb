"""The shared test tables as transcripts and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.schema import Transcript
from scrollmill.sources.sessions import from_tool_results


def document_results(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, msg_idx, tool_call_id, text): documents as tool results, a session a language; without one the session is '', a null text is empty.

    doc_id has to fit an int, which a message's place is.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.select(F.coalesce("lang", F.lit("")).alias("session_id"), F.col("doc_id").cast("int").alias("msg_idx"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("text"))


def tool_results(spark: SparkSession, folder: str) -> Transcript:
    return from_tool_results(document_results(spark, folder))


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, path, idx, kind): views as reads and purchases as writes of a user's path."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    kind: Column = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "write")
    return events.select(F.lit("all").alias("session_id"), F.col("user_id").alias("path"), F.col("event_id").alias("idx"), kind.alias("kind")).where("kind is not null")


def conversation_messages(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, msg_idx, role, text)"""
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("msg_idx"), "role", "text")
