"""Event-time windows that run alike on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, ts: str, size: str, key: str, *aggs: Column, late: str | None = None) -> DataFrame:
    """(start, key, n, aggregates) by tumbling window; ``late``: watermark delay, for streams. ``ts`` must be a timestamp with zone."""
    d = events.withWatermark(ts, late) if late else events
    g = d.groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), *aggs)
    return g.select(F.col("w.start").alias("start"), key, *[c for c in g.columns if c not in ("w", key)])


def read_events(spark: SparkSession, path: str, schema, ts: str = "ts", per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream, with the time column as a timestamp."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withColumn(ts, F.col(ts).cast("timestamp"))


def write_windows(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows appended as Parquet, exactly once, until the source is used up."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
