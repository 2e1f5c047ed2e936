"""Stream-shaped behaviour on Structured Streaming: job progress, rate limits, one-time notices, rebuilds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "review_required")


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a folder as a stream; the schema is given, never inferred."""
    return spark.readStream.schema(schema).parquet(path)


def job_progress(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The latest event of each job (job_id, seq, occurred_at, state), repeats dropped: within the watermark of a stream, or in a table of the history."""
    key = ["job_id", "seq"]
    once = events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)
    latest = once.groupBy("job_id").agg(F.max(F.struct("seq", "occurred_at", "state")).alias("last"))
    return latest.select("job_id", "last.seq", "last.occurred_at", "last.state", F.col("last.state").isin(*TERMINAL).alias("closed"))


def whole_second(c: str) -> Column:
    """The second nearest to a time, as seconds since 1970; halves go to the even one, as SQL casts them."""
    return F.rint(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000).cast("long")


def rate_windows(events: DataFrame, key: str, length: str = "60 seconds", slide: str = "10 seconds", limit: int = 30, delay: str = "5 minutes") -> DataFrame:
    """Sliding windows in which a key has more events than the limit."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), key).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(F.col("window.start").alias("since"), F.col("window.end").alias("until"), key, "n")


def one_time_notices(events: DataFrame) -> DataFrame:
    """The first notice of each kind and resource, missing resources counting as one."""
    return events.withColumn("resource", F.coalesce("resource", F.lit(""))).dropDuplicates(["kind", "resource"])


def statement_notice(failed, reconciled, needs_review):
    """Which one notice a statement gives: failed, then unreconciled, then review, then processed."""
    return F.when(failed, "statement_failed").when(~reconciled, "statement_unreconciled").when(needs_review > 0, "review_required").otherwise("statement_processed")


def rebuild_on_import(stream: DataFrame, rebuild: Callable[[DataFrame], None], checkpoint: str):
    """Runs rebuild(batch) for what has arrived, then stops; rerunning goes on where it ended."""
    return stream.writeStream.foreachBatch(lambda batch, _: rebuild(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
