"""Streaming forms of the event operators (R-01, R-03). Watermarks and windows are an extension of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, folder: str, schema, names: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder with such names as a stream, with ts as an instant."""
    read = spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(folder)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; events later than the watermark are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) per session of a user."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def subscribe(stream: DataFrame, handlers: list[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """R-01: every batch goes to all handlers; the error of one doesn't keep it from the others."""

    def each(batch: DataFrame, number: int) -> None:
        for h in handlers:
            try:
                h(batch, number)
            except Exception:  # noqa: BLE001, S110
                pass

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def alerts(counts: DataFrame, least_total: float) -> DataFrame:
    """R-03: windows whose total is under a limit."""
    return counts.filter(F.col("total") < least_total)
