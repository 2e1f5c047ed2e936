"""Deletions and changes in stored tables: in batches of partitions, each of which replaces only what it touches.

A table is a folder of Parquet files under one partition column. A job first writes what its next partitions will hold, and
how many rows they lose, beside the log; then it replaces the partitions. A job that was stopped goes on by running it
again: a batch that was written whole is put in place first, and counts stay in the log under the job's name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "part string, n long"


@dataclass(frozen=True)
class StoredTable:
    """by: the partition column, a string or a whole number."""

    path: str
    by: str
    schema: T.StructType

    @classmethod
    def write(cls, rows: DataFrame, path: str, by: str) -> StoredTable:
        rows.write.partitionBy(by).parquet(path)
        return cls(path, by, rows.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


class _Files:
    """Hadoop's file system, which reaches whatever store the tables are in."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.system.exists(self.path(path))

    def delete(self, path: str) -> None:
        self.system.delete(self.path(path), True)


def rewrite(spark: SparkSession, table: StoredTable, hit: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame], log: str, job: str, at_once: int = 16) -> int:
    """Changes the rows that hit() marks (adds _hit boolean, keeps all rows) as change() says, and returns how many rows the job has changed so far.

    Only partitions with such rows are rewritten, so many at once. change() must leave no row that would be hit again. log: a
    folder of the caller's, one for each table.
    """
    files, base = _Files(spark, log), f"{log}/{job}"
    while True:
        if files.exists(f"{base}/next/_SUCCESS"):
            _put_in_place(spark, files, table, base)
        marked = hit(table.read(spark))
        found = marked.where("_hit").groupBy(F.col(table.by).alias("part")).agg(F.count("*").alias("n")).orderBy("part")
        parts = found.limit(at_once).collect()  # so many rows
        if not parts:
            break
        here = marked.where(F.col(table.by).isin([p["part"] for p in parts]) | (F.col(table.by).isNull() if parts[0]["part"] is None else F.lit(False)))
        kept = change(here).select(*table.schema.names)
        counts = spark.createDataFrame([(None if p["part"] is None else str(p["part"]), p["n"]) for p in parts], LOG)
        counts.withColumn("_at", F.coalesce("part", F.lit("__null"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_at").parquet(f"{base}/counts")
        counts.write.mode("overwrite").parquet(f"{base}/parts")
        kept.write.mode("overwrite").parquet(f"{base}/next")
    total = spark.read.schema(LOG).parquet(f"{base}/counts").agg(F.sum("n")).first()[0] if files.exists(f"{base}/counts") else 0
    return total or 0


def _put_in_place(spark: SparkSession, files: _Files, table: StoredTable, base: str) -> None:
    new = spark.read.schema(table.schema).parquet(f"{base}/next")
    there = {r["p"] for r in new.select(F.col(table.by).cast("string").alias("p")).distinct().collect()}  # of one batch's partitions
    if there:
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(table.by).parquet(table.path)
    for p in spark.read.schema(LOG).parquet(f"{base}/parts").collect():
        if p["part"] not in there:
            files.delete(f"{table.path}/{table.by}={'__HIVE_DEFAULT_PARTITION__' if p['part'] is None else p['part']}")
    files.delete(f"{base}/next")


def among(keys: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Marks rows whose columns of these names are in keys."""
    names = keys.columns
    once = keys.dropna().distinct().withColumn("_in", F.lit(True))
    return lambda rows: rows.join(once, names, "left").withColumn("_hit", F.col("_in").isNotNull()).drop("_in")


def where(condition: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn("_hit", F.coalesce(condition, F.lit(False)))


def delete_rows(spark: SparkSession, table: StoredTable, hit: Callable[[DataFrame], DataFrame], log: str, job: str, at_once: int = 16) -> int:
    return rewrite(spark, table, hit, lambda rows: rows.where("not _hit"), log, job, at_once)


def erase_tenant(spark: SparkSession, tables: dict[str, StoredTable], tenant_id: int, log: str, at_once: int = 16) -> DataFrame:
    """Removes a tenant from every table; table and rows removed, also those that an earlier run of the same erasure removed."""
    hit = where(F.col("tenant_id") == tenant_id)
    counts = [(name, delete_rows(spark, table, hit, f"{log}/{name}", f"erase-{tenant_id}", at_once)) for name, table in tables.items()]
    return spark.createDataFrame(counts, "frame string, removed long")


def soft_delete(spark: SparkSession, ledger: StoredTable, statements: StoredTable, gone: DataFrame, at: str, log: str, job: str, at_once: int = 16) -> int:
    """Deletes the statements' (gone: statement_id) rows of the ledger, then marks the statements deleted_at; returns the ledger rows removed.

    Statements stay until their retention has passed. A statement that is already marked keeps its time.
    """
    removed = delete_rows(spark, ledger, among(gone), f"{log}/ledger", job, at_once)

    def unmarked(rows: DataFrame) -> DataFrame:
        return among(gone)(rows).withColumn("_hit", F.col("_hit") & F.col("deleted_at").isNull())

    stamp = F.when(F.col("_hit"), F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at"))
    rewrite(spark, statements, unmarked, lambda rows: rows.withColumn("deleted_at", stamp), f"{log}/statements", job, at_once)
    return removed


def sweep(spark: SparkSession, windows: dict[str, tuple[StoredTable, str, int]], today: str, log: str, at_once: int = 16) -> DataFrame:
    """Removes rows whose date column lies so many days back; rows without that date stay. table and rows removed.

    windows: name to (table, date column, days). What has been read, deleted or passed is a matter of that column: unread
    notifications have no read_at, statements that nobody deleted no deleted_at.
    """
    counts = []
    for name, (table, column, days) in windows.items():
        counts.append((name, delete_rows(spark, table, where(_past(column, today, days)), f"{log}/{name}", f"sweep-{today}", at_once)))
    return spark.createDataFrame(counts, "frame string, removed long")


def _past(column: str, today: str, days: int) -> Column:
    return F.col(column).cast("date") < F.date_sub(F.lit(today).cast("date"), days)


def storage_keys(statements: DataFrame, tenant_id: int) -> DataFrame:
    """A tenant's statements (tenant_id, storage_key) that have a stored object."""
    return statements.where((F.col("tenant_id") == tenant_id) & F.col("storage_key").isNotNull())


def sweep_with_objects(
    spark: SparkSession, windows: dict[str, tuple[StoredTable, str, int]], statements: str, today: str, log: str, at_once: int = 16
) -> tuple[DataFrame, DataFrame]:
    """sweep() of all tenants, and tenant_id and storage_key of the objects that its statements (that window's name) leave behind.

    The keys are written down before the first row goes, once for a day: a sweep that was stopped and runs again still knows
    the objects of the rows that are gone already.
    """
    table, column, days = windows[statements]
    keys = f"{log}/objects-{today}"
    if not _Files(spark, keys).exists(f"{keys}/_SUCCESS"):
        gone = table.read(spark).where(_past(column, today, days) & F.col("storage_key").isNotNull())
        gone.select("tenant_id", "storage_key").write.mode("overwrite").parquet(keys)
    schema = T.StructType([f for f in table.schema.fields if f.name in ("tenant_id", "storage_key")])
    return sweep(spark, windows, today, log, at_once), spark.read.schema(schema).parquet(keys)
