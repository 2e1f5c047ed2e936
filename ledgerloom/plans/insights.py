"""Compositions of the operators: the monthly report and the merged timeline."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import grouped, percent
from ..operators import analytics as A
from ..operators import recurring as R


def monthly_insight(ledger: DataFrame, subs: DataFrame, month: date) -> DataFrame:
    """One row per tenant with rows in the month: summary, largest and fastest growing category, largest transaction,
    recurring load, and observations as sentences with the figures behind them."""
    first = F.trunc(F.lit(month), "MM")
    here = ledger.where(F.col("txn_date").between(first, F.last_day(F.lit(month))))
    before = date(month.year - (month.month == 1), (month.month - 2) % 12 + 1, 1)
    summary = A.monthly_summary(here)
    earlier = A.monthly_summary(ledger.where(F.col("txn_date").between(F.lit(before), F.last_day(F.lit(before)))))
    earlier = earlier.select("tenant_id", F.col("net_expenses").alias("was"))
    largest = A.category_breakdown(here).where("place = 1").select("tenant_id", F.struct("slug", "total", "share").alias("largest_category"))
    grown = A.compare_months(ledger, before, month).where("change > 0").groupBy("tenant_id")
    grown = grown.agg(F.min(F.struct((-F.col("change")).alias("less"), "slug", "change")).alias("g"))
    grown = grown.select("tenant_id", F.struct("g.slug", "g.change").alias("fastest_growing"))
    biggest = here.where("is_expense").groupBy("tenant_id").agg(F.min(F.struct((-F.col("amount")).alias("less"), "txn_id", "merchant", "amount")).alias("b"))
    biggest = biggest.select("tenant_id", F.struct("b.txn_id", "b.merchant", "b.amount").alias("largest_transaction"))
    load = R.recurring_load(subs).select("tenant_id", F.struct("n", "annual", "monthly_equivalent").alias("recurring"))
    rows = summary
    for part in (earlier, largest, grown, biggest, load):
        rows = rows.join(part, "tenant_id", "left")
    change = F.col("net_expenses") - F.coalesce("was", F.lit(0))
    # The sentences that are shown.
    both = F.concat_ws(
        ", and ",
        F.when(F.col("untrusted") > 0, F.concat("untrusted", F.lit(" transactions came from statements that have not reconciled"))),
        F.when(F.col("awaiting_review") > 0, F.concat("awaiting_review", F.lit(" transactions are awaiting review"))),
    )
    notes = F.array(
        F.when(F.col("income") > 0, F.concat(F.lit("You kept "), percent("savings_rate").cast("string"), F.lit("% of what you earned this month."))),
        F.concat("largest_category.slug", F.lit(" was your largest category, at "), percent("largest_category.share").cast("string"), F.lit("% of spending.")),
        F.when(change != 0, F.concat(F.lit("You spent "), grouped(change), F.when(change > 0, " more").otherwise(" less"), F.lit(" than the month before."))),
        F.when(
            F.col("recurring.n") > 0,
            F.concat(F.col("recurring.n").cast("string"), F.lit(" recurring charges are costing about "), grouped("recurring.monthly_equivalent"), F.lit(" a month.")),
        ),
        F.when(~F.col("fully_trusted"), F.concat(both, F.lit(". These figures include them."))),
    )
    return rows.withColumn("expense_change", change.cast("decimal(18,2)")).withColumn("observations", F.filter(notes, lambda x: x.isNotNull())).drop("was")


def timeline(
    ledger: DataFrame, statements: DataFrame, date_from: date, date_to: date, limit: int = 200, floor: str = "10000",
    anomalies: DataFrame | None = None, subs: DataFrame | None = None,
) -> DataFrame:
    """Expenses, statements, anomalies and active subscriptions' next charges as one stream, newest first; each source is
    filtered before the union. anomalies and subs are the rows of their operators; without them their branches are left out."""
    kind = F.when(F.col("amount") >= F.lit(floor).cast("decimal(18,2)"), "large_transaction").otherwise("transaction")
    no_amount, nothing = F.lit(None).cast("decimal(18,2)"), F.lit(None).cast("string")

    def branch(rows: DataFrame, on: str, kind: Column, title: Column, summary: Column, amount: Column, ref: Column, detail: Column) -> DataFrame:
        here = rows.where(F.col(on).between(F.lit(date_from), F.lit(date_to)))
        return here.select(
            "tenant_id", F.col(on).alias("occurred_on"), kind.alias("kind"), title.alias("title"), summary.alias("summary"), amount.cast("decimal(18,2)").alias("amount"),
            ref.alias("ref"), detail.alias("detail"),
        )

    c = F.col
    rows = branch(ledger.where("is_expense"), "txn_date", kind, F.coalesce("merchant", F.lit("Transaction")), c("category"), c("amount"), c("txn_id"), c("direction"))
    account = F.concat(F.lit("Account "), c("account_id").cast("string"))
    rows = rows.unionByName(branch(statements, "period_end", F.lit("statement_import"), account, c("document_type"), no_amount, c("statement_id").cast("string"), nothing))
    if anomalies is not None:
        title = F.coalesce("merchant", "category", F.lit("Unusual activity"))
        rows = rows.unionByName(branch(anomalies, "detected_on", F.lit("anomaly"), title, c("reason"), c("observed"), c("txn_id"), c("kind")))
    if subs is not None:
        summary = F.concat(F.lit("Expected "), "cadence", F.lit(" charge"))
        rows = rows.unionByName(branch(subs.where("status = 'active'"), "next_expected_on", F.lit("subscription_renewal"), c("merchant"), summary, c("typical_amount"), nothing, c("cadence")))
    return rows.orderBy(F.desc("occurred_on"), "kind", F.col("ref").asc_nulls_first(), "title").limit(limit)
