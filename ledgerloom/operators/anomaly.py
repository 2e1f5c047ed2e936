"""Anomalies of a ledger, for all tenants and months at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import exact_median, grouped, money, ratio
from ..schema import (
    DUPLICATE_DAYS,
    FIRST_SEEN_MULTIPLE,
    HISTORY_ROWS,
    MAD_SCALE,
    MIN_HISTORY,
    SPIKE_MINIMUM,
    SPIKE_MONTHS,
    SPIKE_RATIO,
    Z_THRESHOLD,
)
from .analytics import month_of

KEY = ["tenant_id", "category", "month"]


def amount_outliers(ledger: DataFrame) -> DataFrame:
    """Expenses 3.5 robust deviations or more from the median of the category's last 200 expenses before their month.

    Uncategorised rows are never flagged. A category needs five earlier rows that are not all alike. The history of a
    month is collected per tenant, category and month, 200 amounts at most.
    """
    spent = ledger.where("is_expense and category is not null").withColumn("month", month_of())
    months = spent.select(*KEY).distinct()
    # A row belongs to the history of a month while fewer than 200 rows lie between, counted from monthly sizes.
    newest = Window.partitionBy(*KEY).orderBy(F.desc("txn_date"), F.desc("txn_id"))
    ranked = spent.select(*KEY, "amount", F.row_number().over(newest).alias("nth")).where(F.col("nth") <= HISTORY_ROWS)
    by_month = ranked.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "amount"))), lambda x: x["amount"]).alias("amounts"))
    sizes = by_month.withColumnRenamed("month", "earlier")
    pairs = months.join(sizes, ["tenant_id", "category"]).where("earlier < month")
    newer = Window.partitionBy(*KEY).orderBy(F.desc("earlier")).rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("ahead", F.coalesce(F.sum(F.size("amounts")).over(newer), F.lit(0))).where(F.col("ahead") < HISTORY_ROWS)
    pairs = pairs.withColumn("amounts", F.slice("amounts", 1, (HISTORY_ROWS - F.col("ahead")).cast("int")))
    history = pairs.groupBy(*KEY).agg(F.flatten(F.collect_list("amounts")).alias("history")).where(F.size("history") >= MIN_HISTORY)
    # The median as a variable: named as a column it would be computed anew for each amount.
    apart = lambda m: F.struct(m.alias("median"), exact_median(F.transform("history", lambda x: F.abs(x - m))).alias("mad"))
    history = history.select(*KEY, F.inline(F.transform(F.array(exact_median(F.col("history"))), apart)))
    scored = spent.join(history.where("mad > 0"), KEY)
    z = F.bround(F.abs(F.col("amount") - F.col("median")).cast("decimal(20,4)") / (F.col("mad") * F.lit(MAD_SCALE).cast("decimal(6,4)")).cast("decimal(20,8)"), 2)
    median = money("median")
    size = F.when(F.col("amount") > median, "large").otherwise("small")
    who = F.coalesce("merchant", F.lit("an unnamed payee"))
    # The sentences that are shown.
    reason = F.concat(grouped("amount"), F.lit(" at "), who, F.lit(" is unusually "), size, F.lit(" for "), "category", F.lit(", where you typically spend "), grouped(median), F.lit("."))
    found = scored.withColumn("robust_z", z.cast("decimal(18,2)")).where(F.col("robust_z") >= F.lit(Z_THRESHOLD).cast("decimal(4,2)"))
    return found.select(
        "tenant_id", "month", F.lit("amount_outlier").alias("kind"), F.col("txn_date").alias("detected_on"), "txn_id", "category", "merchant",
        F.col("amount").alias("observed"), median.alias("baseline"),
        F.least(F.bround(F.col("robust_z") / 10, 3), F.lit(1)).cast("decimal(4,3)").alias("deviation"), "robust_z", reason.alias("reason"),
    )


def category_spikes(ledger: DataFrame) -> DataFrame:
    """Months in which a category is twice its average of the three months before, and 2000 more."""
    monthly = ledger.where("is_expense and category is not null").groupBy("tenant_id", "category", month_of().alias("month"))
    monthly = monthly.agg(money(F.sum("amount")).alias("total"))
    before = monthly.select("tenant_id", "category", F.col("month").alias("at"), F.col("total").alias("was"))
    recent = F.sequence(F.lit(1), F.lit(SPIKE_MONTHS))
    before = before.select("tenant_id", "category", "was", F.explode(F.transform(recent, lambda k: F.add_months("at", k))).alias("month"))
    base = before.groupBy(*KEY).agg(F.sum("was").alias("sum"), F.count("*").alias("months")).where("months >= 2")
    base = base.withColumn("baseline", money(F.col("sum").cast("decimal(20,2)") / F.col("months")))
    both = monthly.join(base, KEY).where("baseline > 0").withColumn("increase", F.col("total") - F.col("baseline"))
    both = both.where((F.col("total") >= F.col("baseline") * F.lit(SPIKE_RATIO).cast("decimal(4,1)")) & (F.col("increase") >= F.lit(SPIKE_MINIMUM).cast("decimal(8,2)")))
    # The sentences that are shown.
    reason = F.concat(
        "category", F.lit(" came to "), grouped("total"), F.lit(" this month, against an average of "), grouped("baseline"),
        F.lit(" over the previous "), F.col("months").cast("string"), F.lit(" months — "), grouped("increase"), F.lit(" more than usual."),
    )
    deviation = F.least(F.bround(F.col("total").cast("decimal(20,2)") / F.col("baseline").cast("decimal(20,2)") / 10, 3), F.lit(1))
    return both.select(
        "tenant_id", "month", F.lit("category_spike").alias("kind"), F.last_day("month").alias("detected_on"), "category",
        F.col("total").alias("observed"), "baseline", "months", ratio("total", "baseline", 2).alias("ratio"),
        deviation.cast("decimal(4,3)").alias("deviation"), reason.alias("reason"),
    )


def duplicate_charges(ledger: DataFrame, days: int = DUPLICATE_DAYS) -> DataFrame:
    """Later rows with merchant, amount and direction of an expense one to three days before. The later need be no expense."""
    left = ledger.where("is_expense and merchant is not null and statement_id is not null").select(
        "tenant_id", "merchant", "amount", "direction", "category", F.col("txn_id").alias("left_id"), F.col("txn_date").alias("left_date"),
        F.explode(F.sequence(F.date_add("txn_date", 1), F.date_add("txn_date", days))).alias("right_date"),
    )
    right = ledger.select("tenant_id", "merchant", "amount", "direction", F.col("txn_id").alias("right_id"), F.col("txn_date").alias("right_date"))
    # Each of the next days by equality, so that a hot amount does not meet all of its rows.
    both = left.join(right, ["tenant_id", "merchant", "amount", "direction", "right_date"]).where("left_id <> right_id")
    gap = F.datediff("right_date", "left_date").cast("string")
    # The sentences that are shown.
    reason = F.concat(
        "merchant", F.lit(" charged "), grouped("amount"), F.lit(" twice within "), gap,
        F.lit(" day(s). This may be a genuine repeat purchase, or a double charge worth checking."),
    )
    return both.select(
        "tenant_id", month_of("left_date").alias("month"), F.lit("duplicate_proximity").alias("kind"), F.col("right_date").alias("detected_on"),
        F.col("right_id").alias("txn_id"), "category", "merchant", F.col("amount").alias("observed"), "left_id", reason.alias("reason"),
    )


#: Steps of an amount's logarithm for each doubling of the amount.
STEPS_AN_OCTAVE = 32


def _medians_before(months: DataFrame, counts: DataFrame) -> DataFrame:
    """The median of each (tenant_id, month) over the counts (tenant_id, step, amount, since, n) whose since is not later."""
    asked = months.join(counts.select("tenant_id", "step").distinct(), "tenant_id").select("tenant_id", "step", "month", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    coarse = counts.groupBy("tenant_id", "step", F.col("since").alias("month")).agg(F.sum("n").alias("n")).withColumn("asked", F.lit(False))
    so_far = F.sum("n").over(Window.partitionBy("tenant_id", "step").orderBy("month"))  # rows of one month count together
    seen = asked.unionByName(coarse).withColumn("n", so_far).where("asked and n > 0")
    whole = Window.partitionBy("tenant_id", "month")
    seen = seen.withColumns({"all": F.sum("n").over(whole), "ahead": F.sum("n").over(whole.orderBy("step")) - F.col("n")})
    seen = seen.withColumns({"low": F.expr("(all - 1) div 2 + 1"), "high": F.expr("all div 2 + 1")})
    middle = seen.where("(ahead < low and low <= ahead + n) or (ahead < high and high <= ahead + n)").select("tenant_id", "month", "step", "ahead", "low", "high")
    near = middle.join(counts, ["tenant_id", "step"]).where("since <= month").groupBy(*middle.columns, "amount").agg(F.sum("n").alias("n"))
    near = near.withColumn("to", F.col("ahead") + F.sum("n").over(Window.partitionBy("tenant_id", "month", "step").orderBy("amount")))
    holds = lambda k: F.min(F.when(F.col("to") >= F.col(k), F.col("amount")))
    medians = near.groupBy("tenant_id", "month").agg(holds("low").alias("a"), holds("high").alias("b"))
    return medians.select("tenant_id", "month", money((F.col("a") + F.col("b")).cast("decimal(20,2)") / 2).alias("median"))


def first_seen_large(ledger: DataFrame) -> DataFrame:
    """Expenses at merchants without any row before the month, of three times the tenant's median expense or more.

    The median is over expenses before the month's last day. Amounts fall into steps that rise with their logarithm; running
    counts by step tell which steps hold the middle, and only those steps' amounts, counted by value, are ranked. So a
    tenant's months meet its steps, some hundreds whatever its rows, and not each of its amounts.
    """
    dated = ledger.withColumn("month", month_of())
    spent = dated.where("is_expense")
    first_month = dated.where("merchant is not null").groupBy("tenant_id", "merchant").agg(F.min("month").alias("month"))
    fresh = spent.join(first_month, ["tenant_id", "merchant", "month"])
    months = fresh.select("tenant_id", "month").distinct()
    # A row counts for its own month unless on that month's last day.
    from_month = F.when(F.col("txn_date") < F.last_day("txn_date"), F.col("month")).otherwise(F.add_months("month", 1))
    step = F.floor(F.log2(F.greatest(F.col("amount").cast("double"), F.lit(0.0)) + 1) * STEPS_AN_OCTAVE).cast("int")
    counts = spent.groupBy("tenant_id", "amount", step.alias("step"), from_month.alias("since")).agg(F.count("*").alias("n"))
    medians = _medians_before(months, counts).where("median > 0")
    large = fresh.join(medians, ["tenant_id", "month"]).where(F.col("amount") >= F.col("median") * F.lit(FIRST_SEEN_MULTIPLE).cast("decimal(4,1)"))
    # The sentences that are shown.
    reason = F.concat(F.lit("First payment to "), "merchant", F.lit(", for "), grouped("amount"), F.lit(" — well above your typical transaction of "), grouped("median"), F.lit("."))
    return large.select(
        "tenant_id", "month", F.lit("merchant_first_large").alias("kind"), F.col("txn_date").alias("detected_on"), "txn_id", "category", "merchant",
        F.col("amount").alias("observed"), F.col("median").alias("baseline"), reason.alias("reason"),
    )


#: What the kinds read of a ledger.
SWEPT = ["tenant_id", "txn_id", "statement_id", "txn_date", "amount", "direction", "is_expense", "merchant", "category"]
Keep = Callable[[DataFrame, str], DataFrame]


def swept(ledger: DataFrame) -> DataFrame:
    """What sweep() reads: no kind looks at a row that is no expense and has no merchant."""
    return ledger.where("is_expense or merchant is not null").select(*SWEPT)


def _with_neighbours(ledger: DataFrame, keep: Keep, days: int = DUPLICATE_DAYS) -> DataFrame:
    """Rows whose merchant, amount and direction come again within the days, among them all that duplicate_charges() pairs.

    Between the rows of a pair no gap is longer than the days, so each has a neighbour within them; most rows have none. Keys
    meet by a hash, so that whole rows need not move; equal hashes of different keys only let more rows through.
    """
    rows = ledger.where("merchant is not null").withColumn("_at", F.xxhash64("tenant_id", "merchant", "amount", "direction"))
    before = F.lag("txn_date").over(Window.partitionBy("_at").orderBy("txn_date"))
    near = rows.select("_at", F.datediff("txn_date", before).alias("gap")).where(F.col("gap") <= days).select("_at").distinct()
    return keep(rows.join(keep(near, "swept-near"), "_at", "left_semi").drop("_at"), "swept-near")


def sweep(ledger: DataFrame, keep: Keep | None = None) -> DataFrame:
    """All four kinds of anomaly in one frame.

    keep(rows, name) stores rows: with it the kinds are found one after another, so that what one has shuffled can go before
    the next.
    """
    kinds = {"outliers": amount_outliers, "spikes": category_spikes, "duplicates": duplicate_charges, "first": first_seen_large}
    frame = None
    for name, find in kinds.items():
        rows = _with_neighbours(ledger, keep) if keep and find is duplicate_charges else ledger
        found = keep(find(rows), f"swept-{name}") if keep else find(rows)
        frame = found if frame is None else frame.unionByName(found, allowMissingColumns=True)
    return frame.select("tenant_id", "month", "kind", "detected_on", "txn_id", "category", "merchant", "observed", "baseline", "deviation", "reason")
