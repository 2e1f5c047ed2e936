"""Ledger analytics, set-based: every function covers all tenants and months of its ledger in one aggregation.

Scope and period are filters on the ledger (``scoped``, ``LedgerFilter``), so they reach the scan. Orders end in a key.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import money, ratio
from ..schema import BREAKDOWN_LIMIT, INCOME_MOVEMENTS, TOP_FOLD, TRANSFER_MOVEMENTS


def scoped(ledger: DataFrame, tenant_id: int | None) -> DataFrame:
    """One tenant's rows; without a tenant no rows at all."""
    return ledger.where(F.lit(False)) if tenant_id is None else ledger.where(F.col("tenant_id") == tenant_id)


def month_of(c: str = "txn_date") -> Column:
    return F.trunc(c, "MM")


@dataclass(frozen=True)
class LedgerFilter:
    """Thirteen optional conditions, all of which must hold. % and _ in the text conditions are wildcards."""

    date_from: date | None = None
    date_to: date | None = None
    category: str | None = None
    account_id: int | None = None
    merchant: str | None = None
    merchant_like: str | None = None
    search: str | None = None
    direction: str | None = None
    review_status: str | None = None
    is_expense: bool | None = None
    min_amount: Decimal | None = None
    max_amount: Decimal | None = None
    max_confidence: Decimal | None = None

    def column(self) -> Column:
        c = F.col
        made = {
            "date_from": lambda v: c("txn_date") >= v,
            "date_to": lambda v: c("txn_date") <= v,
            "merchant_like": lambda v: c("merchant").ilike(f"%{v}%"),
            "search": lambda v: c("description").ilike(f"%{v}%") | c("merchant").ilike(f"%{v}%"),
            "min_amount": lambda v: c("amount") >= v,
            "max_amount": lambda v: c("amount") <= v,
            "max_confidence": lambda v: c("confidence_min") <= v,
        }
        held = [(f.name, getattr(self, f.name)) for f in fields(self)]
        tests = [made.get(name, lambda v, n=name: c(n) == v)(value) for name, value in held if value is not None]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def page(ledger: DataFrame, which: LedgerFilter, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the rows that the filter takes, newest first."""
    return ledger.where(which.column()).orderBy(F.desc("txn_date"), F.desc("txn_id")).offset(offset).limit(limit)


def totals(ledger: DataFrame, which: LedgerFilter) -> DataFrame:
    """Sum, count, least and greatest amount of the rows that the filter takes, as one row."""
    taken = ledger.where(which.column())
    return taken.agg(money(F.sum("amount")).alias("total"), F.count("*").alias("n"), F.min("amount").alias("least"), F.max("amount").alias("most"))


def _sum_if(test: Column) -> Column:
    return money(F.sum(F.when(test, F.col("amount"))))


def _income() -> Column:
    return F.col("movement_type").isin(*INCOME_MOVEMENTS) & (F.col("direction") == "credit")


def with_net(rows: DataFrame) -> DataFrame:
    """Adds net expenses, cash flow and savings rate (0 to 1; 0 without income)."""
    net = F.col("expenses") - F.col("refunds")
    rate = F.when(F.col("income") > 0, F.greatest(F.lit(0), F.least(F.lit(1), ratio(F.col("income") - net, "income"))))
    return rows.withColumns(
        {
            "net_expenses": net.cast("decimal(18,2)"),
            "net_cash_flow": (F.col("income") - net).cast("decimal(18,2)"),
            "savings_rate": F.coalesce(rate, F.lit(0)).cast("decimal(6,4)"),
        }
    )


def monthly_summary(ledger: DataFrame) -> DataFrame:
    """Headline figures by tenant and month, in one pass over the ledger."""
    rows = ledger.groupBy("tenant_id", month_of().alias("month")).agg(
        _sum_if(F.col("is_expense")).alias("expenses"),
        _sum_if(_income()).alias("income"),
        _sum_if(F.col("movement_type") == "refund").alias("refunds"),
        _sum_if(F.col("movement_type").isin(*TRANSFER_MOVEMENTS) & (F.col("direction") == "debit")).alias("transfers"),
        F.count("*").alias("transaction_count"),
        F.count_if("is_expense").alias("expense_transaction_count"),
        F.count_if(~F.col("trust_status").eqNullSafe("trusted")).alias("untrusted"),
        F.count_if(F.col("review_status") == "review_required").alias("awaiting_review"),
    )
    rows = rows.withColumn("fully_trusted", (F.col("untrusted") == 0) & (F.col("awaiting_review") == 0))
    return with_net(rows)


def trend(ledger: DataFrame, until: date, months: int = 12) -> DataFrame:
    """Each tenant's last months up to until's, months without rows as zeros."""
    last = F.trunc(F.lit(until), "MM")
    spine = ledger.select("tenant_id").distinct()
    spine = spine.select("tenant_id", F.explode(F.sequence(F.add_months(last, 1 - months), last, F.expr("interval 1 month"))).alias("month"))
    seen = ledger.where(F.col("txn_date").between(F.add_months(last, 1 - months), F.last_day(F.lit(until))))
    sums = seen.groupBy("tenant_id", month_of().alias("month")).agg(
        _sum_if(F.col("is_expense")).alias("expenses"),
        _sum_if(_income()).alias("income"),
        _sum_if(F.col("movement_type") == "refund").alias("refunds"),
        F.count("*").alias("transaction_count"),
    )
    filled = spine.join(sums, ["tenant_id", "month"], "left").fillna(0)
    return with_net(filled).select("tenant_id", "month", "expenses", "net_expenses", "income", "net_cash_flow", "transaction_count")


def category_breakdown(ledger: DataFrame, limit: int = BREAKDOWN_LIMIT) -> DataFrame:
    """Spending by category for each tenant and month, largest first; shares are of the rows returned."""
    sums = ledger.where("is_expense").groupBy("tenant_id", month_of().alias("month"), F.coalesce("category", F.lit("uncategorised")).alias("slug"))
    sums = sums.agg(money(F.sum("amount")).alias("total"), F.count("*").alias("transaction_count"))
    period = Window.partitionBy("tenant_id", "month")
    top = sums.withColumn("place", F.row_number().over(period.orderBy(F.desc("total"), "slug"))).where(F.col("place") <= limit)
    share = F.coalesce(ratio("total", F.sum("total").over(period)), F.lit(0)).cast("decimal(6,4)")
    return top.withColumn("share", share)


def daily_series(ledger: DataFrame, month: date) -> DataFrame:
    """Each tenant's spending on every day of the month."""
    first, last = F.trunc(F.lit(month), "MM"), F.last_day(F.lit(month))
    seen = ledger.where(F.col("txn_date").between(first, last))
    spine = seen.select("tenant_id").distinct().select("tenant_id", F.explode(F.sequence(first, last)).alias("day"))
    sums = seen.groupBy("tenant_id", F.col("txn_date").alias("day")).agg(
        _sum_if(F.col("is_expense")).alias("expenses"), F.count_if("is_expense").alias("transaction_count")
    )
    return spine.join(sums, ["tenant_id", "day"], "left").fillna(0)


def top_merchants(ledger: DataFrame, limit: int = 10) -> DataFrame:
    """Each tenant's largest merchants over the ledger's period, with the category that most of their rows have."""
    seen = ledger.where("is_expense and merchant is not null")
    by_category = seen.groupBy("tenant_id", "merchant", "category").agg(
        F.sum("amount").alias("total"), F.count("*").alias("n"), F.max("txn_date").alias("last_seen")
    )
    # The most frequent category, of equals the lowest; rows without one do not vote.
    rank = F.when(F.col("category").isNotNull(), F.struct(-F.col("n"), "category"))
    sums = by_category.groupBy("tenant_id", "merchant").agg(
        money(F.sum("total")).alias("total"),
        F.sum("n").alias("transaction_count"),
        F.max("last_seen").alias("last_seen"),
        F.min(rank)["category"].alias("category"),
    )
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("total"), "merchant"))
    top = sums.withColumn("place", place).where(F.col("place") <= limit)
    return top.withColumn("average", ratio("total", "transaction_count", 2).cast("decimal(18,2)"))


def compare_months(ledger: DataFrame, left: date, right: date) -> DataFrame:
    """Categories of two months side by side per tenant; no percentage on a zero base."""

    def of(month: date, name: str) -> DataFrame:
        first = F.trunc(F.lit(month), "MM")
        rows = category_breakdown(ledger.where(F.col("txn_date").between(first, F.last_day(F.lit(month)))))
        return rows.select("tenant_id", "slug", F.col("total").alias(name))

    both = of(left, "before").join(of(right, "after"), ["tenant_id", "slug"], "full_outer").fillna(0, ["before", "after"])
    return both.withColumns(
        {"change": (F.col("after") - F.col("before")).cast("decimal(18,2)"), "percent_change": ratio(F.col("after") - F.col("before"), "before")}
    )


def review_stats(ledger: DataFrame) -> DataFrame:
    """Rows by review state, per tenant."""
    states = ("review_required", "flagged", "auto_approved", "approved", "corrected")
    return ledger.groupBy("tenant_id").agg(*(F.count_if(F.col("review_status") == s).alias(s) for s in states), F.count("*").alias("total"))


def category_usage(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category with its rows and spending, unused ones too."""
    used = ledger.groupBy("category").agg(F.count("*").alias("n"), _sum_if(F.col("is_expense")).alias("spent"))
    rows = categories.select("category").join(used, "category", "left")
    return rows.select("category", F.coalesce("n", F.lit(0)).alias("n"), money("spent").alias("spent"))


def fold_tail(rows: DataFrame, keys: list[str], label: str, value: str, head: int = TOP_FOLD) -> DataFrame:
    """The largest values of each key, and the sum of the others as "Other"."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), label))
    rows = rows.withColumn(label, F.when(place <= head, F.col(label)).otherwise("Other"))
    return rows.groupBy(*keys, label).agg(F.sum(value).cast("decimal(18,2)").alias(value))


def histogram(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Rows by the first edge that the value does not exceed; the last bucket (null edge) has no upper edge."""
    found = F.lit(None).cast("double")
    for edge in sorted(edges, reverse=True):
        found = F.when(value <= edge, F.lit(float(edge))).otherwise(found)
    return rows.select(found.alias("edge")).groupBy("edge").agg(F.count("*").alias("n"))


def account_coverage(statements: DataFrame) -> DataFrame:
    """First and last day that an account's statements cover, and the closing balance of the latest with one."""
    latest = F.max_by("closing_balance", F.when(F.col("closing_balance").isNotNull(), F.struct("period_end", "statement_id")))
    return statements.groupBy("tenant_id", "account_id").agg(
        F.min("period_start").alias("covers_from"), F.max("period_end").alias("covers_to"), latest.alias("balance"), F.count("*").alias("statements")
    )


def account_counts(ledger: DataFrame, statements: DataFrame) -> DataFrame:
    """Accounts with their rows and statements; each side is counted before the join."""
    rows = ledger.groupBy("tenant_id", "account_id").agg(F.count("*").alias("transactions"))
    held = statements.groupBy("tenant_id", "account_id").agg(F.count("*").alias("statements"))
    return rows.join(held, ["tenant_id", "account_id"], "full_outer").fillna(0, ["transactions", "statements"])
