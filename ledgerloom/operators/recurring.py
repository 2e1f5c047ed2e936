"""Recurring charges, projections and budgets, with array expressions instead of user functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import exact_median, money, ratio
from ..schema import CADENCES, LAPSE_GRACE_DAYS, LOOKBACK_DAYS, MIN_OCCURRENCES, MIN_PROJECTION_DAYS, MIN_STABILITY


def _mode(c: str) -> Column:
    """The most frequent value, of equals the lowest; nulls do not vote."""
    return F.expr(f"mode() WITHIN GROUP (ORDER BY {c})")


def _cadence(days: Column, place: int) -> Column:
    found = F.lit(None)
    for cadence in reversed(CADENCES):
        found = F.when(F.abs(days - cadence[1]) <= cadence[2], F.lit(cadence[place])).otherwise(found)
    return found


def next_charge(last: Column, days: Column, cadence_months: Column) -> Column:
    """Calendar cadences keep the day of the month, clamped to its length; others add days."""
    return F.when(cadence_months > 0, F.add_months(last, cadence_months)).otherwise(F.date_add(last, days.cast("int")))


KEY = ["tenant_id", "merchant"]


def candidates(ledger: DataFrame, since: date) -> DataFrame:
    """Merchants charged three times or more since a day, with their first and last charge and most frequent category."""
    charges = ledger.where("is_expense and merchant is not null").where(F.col("txn_date") >= F.lit(since)).groupBy(*KEY)
    ends = F.min("txn_date").alias("first_charge_on"), F.max("txn_date").alias("last_charge_on")
    return charges.agg(F.count("*").alias("occurrence_count"), *ends, _mode("category").alias("category")).where(F.col("occurrence_count") >= MIN_OCCURRENCES)


def steady_merchants(charges: DataFrame) -> DataFrame:
    """Merchants charged three times or more at a steady cadence, by the days between their charges.

    Charges are counted by day first, so that a merchant's list has a day once however often it was charged; further
    charges of a day are gaps of no days, and are counted and not listed.
    """
    rows = charges.groupBy(*KEY, "txn_date").agg(F.count("*").alias("n")).groupBy(*KEY)
    rows = rows.agg(F.array_sort(F.collect_list("txn_date")).alias("days"), F.sum("n").alias("occurrence_count"))
    rows = rows.where(F.col("occurrence_count") >= MIN_OCCURRENCES)
    waits = F.transform(F.slice("days", 2, F.size("days")), lambda d, i: F.datediff(d, F.get("days", i)).cast("decimal(10,1)"))
    rows = rows.withColumns({"waits": F.sort_array(waits), "same_day": F.col("occurrence_count") - F.size("days"), "gaps": F.col("occurrence_count") - 1})

    def nth(place: str) -> Column:
        k = F.expr(place)
        return F.when(k < F.col("same_day"), F.lit(0).cast("decimal(10,1)")).otherwise(F.get("waits", (k - F.col("same_day")).cast("int")))

    rows = rows.withColumn("typical_gap", ((nth("(gaps - 1) div 2") + nth("gaps div 2")) / 2).cast("decimal(20,4)"))
    none = (F.col("same_day") * F.col("typical_gap")).cast("decimal(20,4)")
    spread = F.aggregate("waits", none, lambda a, g: (a + F.abs(g - F.col("typical_gap"))).cast("decimal(20,4)"))
    steady = 1 - (spread.cast("double") / F.col("gaps")) / F.col("typical_gap").cast("double")
    score = F.when(F.col("gaps") < 2, F.lit(0.5)).when(F.col("typical_gap") <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), steady))
    rows = rows.withColumns({"stability": F.bround(score, 3).cast("decimal(4,3)"), "cadence": _cadence(F.col("typical_gap"), 0)})
    rows = rows.where(F.col("cadence").isNotNull() & (F.col("stability") >= F.lit(MIN_STABILITY).cast("decimal(4,3)")))
    ends = {"first_charge_on": F.get("days", F.lit(0)), "last_charge_on": F.element_at("days", -1)}
    return rows.withColumns(ends).select(*KEY, "occurrence_count", "typical_gap", "stability", "cadence", *ends)


def subscriptions(ledger: DataFrame, today: date, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Merchants whose charges follow a cadence steadily, with the next charge that is due.

    Amounts are collected of steady merchants only. Half of their gaps are five days or more, what the shortest
    cadence allows, so their charges are at most two for every five days covered.
    """
    since = _days_before(today, lookback)
    seen = ledger.where("is_expense and merchant is not null").where(F.col("txn_date") >= F.lit(since))
    steady = steady_merchants(seen)
    charged = seen.join(steady.select(*KEY), KEY).groupBy(*KEY).agg(
        money(exact_median(F.collect_list("amount"))).alias("typical_amount"),
        F.max(F.struct("txn_date", "txn_id", "amount"))["amount"].alias("last_amount"),
        _mode("category").alias("category"), _mode("account_id").alias("account_id"),
    )
    rows = steady.join(charged, KEY)
    rows = rows.withColumn("next_expected_on", next_charge(F.col("last_charge_on"), F.floor("typical_gap"), _cadence(F.col("typical_gap"), 4)))
    lapsed = F.col("next_expected_on") < F.date_sub(F.lit(today), LAPSE_GRACE_DAYS)
    return rows.select(
        "tenant_id", "merchant", "category", "account_id", "cadence", "stability", "typical_amount", "last_amount",
        (F.col("typical_amount") * _cadence(F.col("typical_gap"), 3)).cast("decimal(18,2)").alias("estimated_annual_cost"),
        "first_charge_on", "last_charge_on", "next_expected_on", "occurrence_count",
        F.when(lapsed, "lapsed").otherwise("active").alias("status"),
    )


def _days_before(day: date, days: int) -> date:
    return date.fromordinal(day.toordinal() - days)


def recurring_load(subs: DataFrame) -> DataFrame:
    """Active subscriptions per tenant: how many, what they cost a year and, spread evenly, a month."""
    a_month = F.lit(None).cast("decimal(38,6)")
    for name, _, _, charges, _ in CADENCES:
        each = F.col("typical_amount").cast("decimal(18,2)") * charges / 12
        a_month = F.when(F.col("cadence") == name, each.cast("decimal(38,6)")).otherwise(a_month)
    active = subs.where("status = 'active'").groupBy("tenant_id")
    return active.agg(F.count("*").alias("n"), money(F.sum("estimated_annual_cost")).alias("annual"), money(F.sum(a_month)).alias("monthly_equivalent"))


def project_month(ledger: DataFrame, subs: DataFrame, month: date, today: date) -> DataFrame:
    """Per tenant: what the month will come to, by the rate so far or by what is known to be due, whichever is more."""
    first = month.replace(day=1)
    last = date(first.year + first.month // 12, first.month % 12 + 1, 1)
    last = date.fromordinal(last.toordinal() - 1)
    as_of, days = min(today, last), last.day
    elapsed = (as_of - first).days + 1 if as_of >= first else 0
    whole = elapsed >= days
    spent = ledger.groupBy("tenant_id").agg(money(F.sum(F.when(F.col("is_expense") & F.col("txn_date").between(F.lit(first), F.lit(as_of)), F.col("amount")))).alias("spent_so_far"))
    due = subs.where("status = 'active'").where((F.col("next_expected_on") > F.lit(as_of)) & (F.col("next_expected_on") <= F.lit(last)))
    due = due.groupBy("tenant_id").agg(F.sum("typical_amount").alias("due"))
    rows = spent.join(due, "tenant_id", "left")
    rate = F.col("spent_so_far") if whole else money(F.col("spent_so_far").cast("decimal(20,2)") / max(elapsed, 1) * days)
    upcoming = F.lit(0).cast("decimal(18,2)") if whole else money("due")
    rows = rows.withColumns({"run_rate_projection": rate.cast("decimal(18,2)"), "upcoming_recurring": upcoming})
    known = (F.col("spent_so_far") + F.col("upcoming_recurring")).cast("decimal(18,2)")
    return rows.drop("due").withColumns(
        {
            "days_elapsed": F.lit(min(elapsed, days)),
            "days_in_month": F.lit(days),
            "projected_total": F.greatest("run_rate_projection", known),
            "reliable": F.lit(whole or elapsed >= MIN_PROJECTION_DAYS),
        }
    )


def budget_progress(ledger: DataFrame, budgets: DataFrame, month: date, today: date) -> DataFrame:
    """Active budgets (tenant_id, category, amount, alert_threshold, is_active) with what the month spent of them."""
    first = month.replace(day=1)
    last = date.fromordinal(date(first.year + first.month // 12, first.month % 12 + 1, 1).toordinal() - 1)
    as_of = min(today, last)
    elapsed = min((as_of - first).days + 1, last.day) if as_of >= first else 0
    spent = ledger.where("is_expense").where(F.col("txn_date").between(F.lit(first), F.lit(last)))
    spent = spent.groupBy("tenant_id", "category").agg(F.sum("amount").alias("spent"))
    rows = budgets.where("is_active").join(spent, ["tenant_id", "category"], "left").withColumn("spent", money("spent"))
    share = F.coalesce(ratio("spent", "amount"), F.lit(0)).cast("decimal(18,4)")
    scale = F.lit(last.day).cast("decimal(20,0)") / max(elapsed, 1)
    projected = money(F.col("spent") * scale) if elapsed else F.col("spent")
    rows = rows.withColumns({"remaining": (F.col("amount") - F.col("spent")).cast("decimal(18,2)"), "share_used": share, "projected_total": projected})
    state = F.when(F.col("share_used") >= 1, "exceeded").when(F.col("share_used") >= F.col("alert_threshold"), "warning").otherwise("on_track")
    return rows.withColumn("state", state)
