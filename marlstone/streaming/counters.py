"""Structured Streaming forms of the counters, limits and heartbeats.

Late rows are dropped behind a watermark of ten minutes; windows close in append
mode. Every stream can be drained with trigger(availableNow=True).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WATERMARK = "10 minutes"


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of Parquet files with the column ts as a timestamp."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def minute_counts(events: DataFrame, by: str, at: str = "ts") -> DataFrame:
    """Requests of each key by aligned minute: the approximate form of the rate limit."""
    return events.withWatermark(at, WATERMARK).groupBy(by, F.window(at, "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("minute"), "n")


def daily_usage(events: DataFrame, by: str, value: str, at: str = "ts") -> DataFrame:
    return events.withWatermark(at, WATERMARK).groupBy(by, F.window(at, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.sum(value).alias("volume")).select(by, F.col("w.start").cast("date").alias("day"), "requests", "volume")


def heartbeat_sessions(events: DataFrame, by: str, at: str = "ts", gap: str = "5 minutes") -> DataFrame:
    """Spans in which a node was online: it goes offline after a gap without events."""
    return events.withWatermark(at, WATERMARK).groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("beats")).select(by, F.col("w.start").alias("online_from"), F.col("w.end").alias("offline_at"), "beats")


def value_histogram(events: DataFrame, kind: str, value: str, width: float) -> DataFrame:
    """Running counts by kind and bin (complete mode)."""
    return events.groupBy(kind, F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rate_limiter(events: DataFrame, by: str, limit: int, at: str = "ts", ttl_seconds: int = 60) -> DataFrame:
    """Exact limit: a key's counter lives ttl_seconds from its first hit; by, minute_start, hits, rejected when a counter ends.

    Keys are cast to text. State is one counter for each key; a negative limit means no limit.
    """
    out = f"{by} string, started timestamp, hits long, rejected long"

    def count(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        started, hits = state.get if state.exists else (0, 0)
        rows = []
        if state.hasTimedOut:
            rows.append((started, hits))
            state.remove()
        else:
            times = sorted(t for b in batches for t in b["_us"].tolist())
            for t in times:
                if hits and t >= started + ttl_seconds * 1_000_000:
                    rows.append((started, hits))
                    hits = 0
                if not hits:
                    started = t
                hits += 1
            state.update((started, hits))
            state.setTimeoutTimestamp(max((started + ttl_seconds * 1_000_000) // 1000, state.getCurrentWatermarkMs() + 1))
        if rows:
            over = [0 if limit < 0 else max(0, n - limit) for _, n in rows]
            yield pd.DataFrame({by: [key[0]] * len(rows), "started": pd.to_datetime([s for s, _ in rows], unit="us"), "hits": [n for _, n in rows], "rejected": over})

    stream = events.withWatermark(at, WATERMARK).select(F.col(by).cast("string").alias(by), at, F.unix_micros(at).alias("_us"))
    return stream.groupBy(by).applyInPandasWithState(count, out, "started long, hits long", "append", "EventTimeTimeout")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a Parquet table (append) or a memory table (complete, update) and read it."""
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/data")

    def replace(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/data")

    stream.writeStream.outputMode(mode).foreachBatch(replace).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
