"""Landed pages as a stream into keyed tables, and event-time extensions.

The catalog itself polls; a stream over the landing folder with the trigger availableNow does the same work for
the files that are new since the last run, and its checkpoint remembers which those are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sinks.tables import Snapshots


def read_landing(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def upsert_stream(stream: DataFrame, table: Snapshots, key: list[str], newest: str, checkpoint: str, transform=lambda df: df) -> StreamingQuery:
    """Every micro-batch is merged: the newest row of a key wins, so late corrections replace what was read before (ST3, ST8).

    A batch rewrites the buckets that it touches; one that is run again after a crash gives the same table.
    """

    def batch(df: DataFrame, _: int) -> None:
        table.merge(transform(df), key, newest)
        table.vacuum()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Extension: events per day and type, with a watermark for late rows (batch or stream)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Extension: sessions of a user, ended by a gap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")
