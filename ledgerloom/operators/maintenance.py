"""Changes to stored frames, as projections and joins: corrections, approvals, retention, erasure, orphans."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORRECTABLE = ("merchant", "category", "movement_type", "is_expense", "direction", "amount")


def corrected(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """The effective ledger: each correctable column takes its latest correction that names one.

    corrections: tenant_id, txn_id, seq, and a column for each correctable one, null where it stays. The ledger itself
    is never rewritten.
    """
    latest = corrections.groupBy("tenant_id", "txn_id").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in CORRECTABLE), F.max("seq").alias("_seq")
    )
    rows = ledger.join(latest, ["tenant_id", "txn_id"], "left")
    rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in CORRECTABLE})
    rows = rows.withColumn("review_status", F.when(F.col("_seq").isNotNull(), "corrected").otherwise(F.col("review_status")))
    return rows.drop("_seq", *(f"_{c}" for c in CORRECTABLE))


def approved(ledger: DataFrame, which: Column) -> DataFrame:
    """Rows that the condition takes become approved."""
    return ledger.withColumn("review_status", F.when(which, "approved").otherwise(F.col("review_status")))


def applied_to_similar(ledger: DataFrame, merchant: str, category: str) -> DataFrame:
    """Unverified rows of the merchant take the category."""
    hit = (F.col("merchant") == merchant) & ~F.col("review_status").isin("approved", "corrected")
    return ledger.withColumn("category", F.when(hit, category).otherwise(F.col("category")))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with its rows of the same keys replaced."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def upsert_additive(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows' numbers added to those of the same keys."""
    both = table.unionByName(rows)
    return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in table.columns if c not in keys))


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table and those rows whose keys it lacks, the first of each key."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti"))


def retained(frames: dict[str, tuple[DataFrame, str, int]], today: date) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each frame (frame, date column, days kept) without its expired rows, and how many rows each loses."""
    kept, counts = {}, None
    for name, (frame, column, days) in frames.items():
        old = F.col(column) < F.date_sub(F.lit(today), days)
        kept[name] = frame.where(~old | F.col(column).isNull())
        own = frame.agg(F.lit(name).alias("frame"), F.count_if(old).alias("removed"))
        counts = own if counts is None else counts.unionByName(own)
    return kept, counts


def erased(frame: DataFrame, tenant_id: int) -> DataFrame:
    """The frame without a tenant."""
    return frame.where(~F.col("tenant_id").eqNullSafe(tenant_id))


def without_statement(ledger: DataFrame, statements: DataFrame) -> DataFrame:
    """The ledger without the rows of the statements."""
    return ledger.join(statements.select("statement_id"), "statement_id", "left_anti")


def orphan_report(objects: DataFrame, live: DataFrame, tenants: DataFrame, most: float = 0.25) -> DataFrame:
    """Objects (key) that nothing live names, as counts, and whether deleting them must be refused.

    Refused: without tenants, without live objects, or when more than a quarter of all objects would go.
    """
    orphans = objects.join(live, "key", "left_anti").agg(F.count("*").alias("orphans"))
    row = objects.agg(F.count("*").alias("objects")).join(orphans).join(live.agg(F.count("*").alias("live"))).join(tenants.agg(F.count("*").alias("tenants")))
    reason = F.when(F.col("tenants") == 0, "no_tenants").when(F.col("live") == 0, "empty_live_set").when(F.col("orphans") > most * F.col("objects"), "too_many")
    return row.withColumn("refused", reason)
