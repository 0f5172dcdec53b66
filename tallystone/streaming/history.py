"""A stream over the history of runs or events: an extension, the batch operators are the reference's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New JSON files of an append-only history."""
    return spark.readStream.schema(schema).json(path)


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(from, kind, n) of tumbling windows; rows later than `late` behind the newest are left to the batch run."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    g = d.groupBy(F.window(ts, window), kind).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("from"), kind, "n")


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Append finished windows as Parquet, then stop: one pass over what is there."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
