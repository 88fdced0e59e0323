"""Live operators on Structured Streaming. Each works on a batch frame too, where watermarks have no effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolith.sources.store import PollStore


def file_stream(spark: SparkSession, path: str, schema: str, pattern: str = "*", files_per_poll: int = 100) -> DataFrame:
    """Landing folder as a stream: each poll takes new files alone, and each file once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_poll).option("pathGlobFilter", pattern).parquet(path)


def first_seen(stream: DataFrame, key: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key has not been seen within the delay: exactly-once by payload digest or natural key."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key) if stream.isStreaming else stream.dropDuplicates(key)


def windowed(stream: DataFrame, time: str, by: list[str], size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; data later than the delay is dropped by the watermark."""
    late = stream.withWatermark(time, delay) if stream.isStreaming else stream
    window = F.window(time, size, slide) if slide else F.window(time, size)
    g = late.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(*by, F.col("w.start").alias("window_start"), "n", "total")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    late = stream.withWatermark(time, delay) if stream.isStreaming else stream
    g = late.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.max(time).alias("last_seen"))
    return g.select(*by, F.col("w.start").alias("session_start"), "last_seen", "n")


def future_split(rows: DataFrame, time: str, retrieved: str, tolerance_minutes: int = 10) -> DataFrame:
    """rows with `is_future`: the observation is later than its retrieval by more than the tolerance."""
    return rows.withColumn("is_future", F.col(time) > F.col(retrieved) + F.make_dt_interval(mins=F.lit(tolerance_minutes)))


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there, write it as Parquet and return it as a batch."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def poll_into(store: str, key: list[str], time: str, retrieved: str, tolerance_minutes: int = 10, newer: Column | None = None, buckets: int = 8, compact_every: int = 16) -> Callable[[DataFrame, int], None]:
    """Work for each_poll: rows of a poll that are new by key go into the PollStore at store, those from the future to store/future.

    Late rows are taken like others and keys are known for ever; a poll opens only files that may hold its keys. A row
    that differs from the one that stands is left out, or with `newer` (see PollStore.merge) its next version. A poll writes
    under its number, so that one that runs again after a failure replaces what it wrote. Every compact_every polls, files are merged.
    """

    def work(batch: DataFrame, poll: int) -> None:
        rows = future_split(batch, time, retrieved, tolerance_minutes)
        content = [c for c in batch.columns if c not in (*key, retrieved)]
        kept = PollStore(batch.sparkSession, store, key, time, content or [retrieved], buckets)
        kept.merge(rows.where("not is_future").drop("is_future"), poll, F.lit(False) if newer is None else newer)
        rows.where("is_future").drop("is_future").write.mode("overwrite").parquet(f"{store}/future/poll={poll}")
        if poll % compact_every == compact_every - 1:
            kept.compact()

    return work


def each_poll(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], interval: str = "5 minutes"):
    """Run `work` on every micro-batch; the checkpoint makes a poll's number and its files repeat after a failure."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
