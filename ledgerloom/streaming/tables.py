"""Streams that run over what there is and end, and tables that they keep."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.insights import monthly_insight

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which all executors share; a temporary folder only where Spark runs in one process.

    What is written there goes when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_folder()
    path = f"{base.rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared folder, for what reads them many times.

    Spark's cleaner drops the shuffle files behind the table once the driver has collected its garbage.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    for _ in range(2):  # the second time for what listeners still held the first time
        spark._jvm.System.gc()
        time.sleep(0.2)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def keyed_state(spark: SparkSession):
    """Holds the session to the state store that processors with timers and lists need, and gives the caller's setting back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def landed(rows: DataFrame, name: str) -> DataFrame:
    """The rows written as files of a new folder, and that folder as a stream."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what has arrived, appending to a Parquet table, and reads the table; a later call goes on from there."""
    spark = stream.sparkSession
    with keyed_state(spark):
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


SNAPSHOT_MONTHS = 3


def _months(today: date, months: int) -> list[date]:
    first, found = today.replace(day=1), []
    for _ in range(months):
        found.append(first)
        first = date(first.year - (first.month == 1), (first.month - 2) % 12 + 1, 1)
    return found


def snapshot(ledger: DataFrame, subs: DataFrame, month: date) -> DataFrame:
    """A row per tenant with rows in the month, as it is stored: figures, the largest and the fastest growing category, the largest transaction, and the rest as JSON."""
    rows = monthly_insight(ledger, subs, month)
    return rows.select(
        "tenant_id", F.lit(month).alias("period_month"), F.col("net_expenses").alias("total_expenses"), F.col("income").alias("total_income"), "net_cash_flow",
        F.bround("savings_rate", 3).cast("decimal(4,3)").alias("savings_rate"), F.col("largest_category.slug").alias("largest_category"),
        F.col("fastest_growing.slug").alias("fastest_growing_category"), F.col("largest_transaction.txn_id").alias("largest_transaction"), "transaction_count",
        F.col("awaiting_review").alias("unreviewed_count"), F.col("untrusted").alias("untrusted_count"), F.to_json(F.struct("observations", "recurring")).alias("breakdown"),
    )


def _overwrite(df: DataFrame, path: str, *columns: str) -> None:
    """Writes df below path; of the table's partitions only those that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def rebuild_after_import(ledger_path: str, snapshots_path: str, subscriptions: Callable[[DataFrame, date], DataFrame], today: date, months: int = SNAPSHOT_MONTHS):
    """What foreachBatch calls with imported ledger rows: stores them, then builds the snapshots of the last months anew.

    Rows are stored under their month and the batch's number, and a snapshot under its month, so a batch that runs twice
    replaces what it wrote. Corrections land on old rows, so today's month and the ones before are rebuilt.
    """

    def rebuild(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        stored = batch.withColumns({"month": F.date_format("txn_date", "yyyy-MM"), "import_id": F.lit(number).cast("long")})
        _overwrite(stored, ledger_path, "month", "import_id")
        table = spark.read.schema(stored.schema).parquet(ledger_path)
        subs = subscriptions(table.select(schema.names), today)
        for month in _months(today, months):
            near = [f"{m:%Y-%m}" for m in _months(month, 2)]
            rows = snapshot(table.where(F.col("month").isin(near)).select(schema.names), subs, month)
            _overwrite(rows, snapshots_path, "period_month")

    return rebuild
