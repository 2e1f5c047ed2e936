"""Anomalies, recurring charges, projections, budgets and the timeline."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import anomaly as N
from ..operators import recurring as R
from ..plans import insights as I
from ..sources import adapters as S
from ..streaming import tables as W
from .ledger import BREAKDOWN, L1, MONTH, SUMS
from .registry import ORACLE_SQL, query

L2, L3 = "WITH " + S.EVENTS_SQL, "WITH " + S.ORDERS_SQL
TODAY = date(2000, 6, 15)
INR = "'₹' || regexp_replace(split_part({0}::DECIMAL(18,2)::VARCHAR, '.', 1), '(\\d)(?=(\\d\\d)*\\d{{3}}$)', '\\1,', 'g') || '.' || split_part({0}::DECIMAL(18,2)::VARCHAR, '.', 2)"


def inr(c: str) -> str:
    """Indian grouping in DuckDB, whose regular expressions have no look-ahead: last three digits, then pairs."""
    text = f"({c})::DECIMAL(18,2)::VARCHAR"
    whole, cents = f"split_part({text}, '.', 1)", f"split_part({text}, '.', 2)"
    head = f"reverse(regexp_replace(reverse(left({whole}, length({whole}) - 3)), '(\\d\\d)', '\\1,', 'g'))"
    return f"'₹' || CASE WHEN length({whole}) > 3 THEN ltrim({head}, ',') || ',' || right({whole}, 3) ELSE {whole} END || '.' || {cents}"


def half_even(cents: str, n: str) -> str:
    """cents / n as money, half to even, in whole numbers: DuckDB divides decimals as doubles."""
    q, r = f"divide({cents}, {n})", f"(({cents}) % {n})"
    return f"((CASE WHEN 2 * {r} > {n} OR (2 * {r} = {n} AND {q} % 2 = 1) THEN {q} + 1 ELSE {q} END)::DECIMAL(18,2) / 100)::DECIMAL(18,2)"


OUTLIERS = """
e AS (SELECT *, date_trunc('month', txn_date)::DATE AS month FROM {0} WHERE is_expense AND category IS NOT NULL),
months AS (SELECT DISTINCT tenant_id, category, month FROM e),
h AS (SELECT m.tenant_id, m.category, m.month, e.amount, row_number() OVER (
        PARTITION BY m.tenant_id, m.category, m.month ORDER BY e.txn_date DESC, e.txn_id DESC) AS r
      FROM months m JOIN e ON e.tenant_id = m.tenant_id AND e.category = m.category AND e.month < m.month),
k AS (SELECT tenant_id, category, month, count(*) AS n, list_sort(list(amount)) AS a FROM h WHERE r <= 200 GROUP BY ALL),
q AS (SELECT *, (a[divide(n + 1, 2)::INT] + a[divide(n, 2)::INT + 1])::DECIMAL(20,4) * 0.5 AS med FROM k WHERE n >= 5),
d AS (SELECT *, list_sort(list_transform(a, lambda x: abs(x - med))) AS v FROM q),
s AS (SELECT tenant_id, category, month, med, (v[divide(n + 1, 2)::INT] + v[divide(n, 2)::INT + 1]) * 0.5 AS mad FROM d),
outliers AS (SELECT e.*, round_even(med, 2)::DECIMAL(18,2) AS baseline,
        round_even(abs(amount - med)::DOUBLE / (mad * 1.4826)::DOUBLE, 2)::DECIMAL(18,2) AS robust_z
      FROM e JOIN s USING (tenant_id, category, month) WHERE mad > 0)"""


@query(
    "A9_W8_amount_outliers",
    f"""{L2}, w AS (SELECT * REPLACE (DATE '2023-01-01' + 12 * (txn_date - DATE '2024-01-01')::INT AS txn_date) FROM l2), {OUTLIERS.format("w")}
SELECT tenant_id, month, 'amount_outlier' AS kind, txn_date AS detected_on, txn_id, category, merchant, amount AS observed, baseline,
  least(round_even(robust_z / 10, 3), 1)::DECIMAL(4,3) AS deviation, robust_z,
  {inr("amount")} || ' at ' || coalesce(merchant, 'an unnamed payee') || ' is unusually ' || CASE WHEN amount > baseline THEN 'large' ELSE 'small' END
  || ' for ' || category || ', where you typically spend ' || {inr("baseline")} || '.' AS reason
FROM outliers WHERE robust_z >= 3.5""",
)
def amount_outliers(spark, sf_dir):
    # The events' 30 days, drawn out to 12 months, so that later months have a history.
    day = F.datediff("txn_date", F.lit("2024-01-01").cast("date"))
    return N.amount_outliers(S.events_ledger(spark, sf_dir).withColumn("txn_date", F.date_add(F.lit("2023-01-01").cast("date"), day * 12)))


SPIKES = f"""s AS ({BREAKDOWN.replace("coalesce(category, 'uncategorised') AS slug", "category")}), b AS (
  SELECT c.tenant_id, c.category, c.month, c.total, count(*) AS months, {half_even("(sum(p.total) * 100)::BIGINT", "count(*)")} AS baseline
  FROM s c JOIN s p ON p.tenant_id = c.tenant_id AND p.category = c.category AND p.month < c.month AND p.month >= c.month - INTERVAL 3 MONTH
  GROUP BY ALL
)"""


@query(
    "A8_J3_category_spikes",
    f"""{L1}, {SPIKES}
SELECT tenant_id, month, 'category_spike' AS kind, last_day(month) AS detected_on, category, total AS observed, baseline, months,
  round_even(total::DOUBLE / baseline::DOUBLE, 2)::DECIMAL(18,2) AS ratio,
  least(round_even(total::DOUBLE / baseline::DOUBLE / 10, 3), 1)::DECIMAL(4,3) AS deviation,
  category || ' came to ' || {inr("total")} || ' this month, against an average of ' || {inr("baseline")} || ' over the previous ' || months
  || ' months — ' || {inr("total - baseline")} || ' more than usual.' AS reason
FROM b WHERE months >= 2 AND baseline > 0 AND total >= baseline * 2 AND total - baseline >= 2000""",
)
def category_spikes(spark, sf_dir):
    return N.category_spikes(S.lineitem_ledger(spark, sf_dir))


@query(
    "A12_J4_duplicate_charges",
    f"""{L2} SELECT a.tenant_id, date_trunc('month', a.txn_date)::DATE AS month, 'duplicate_proximity' AS kind, b.txn_date AS detected_on,
  b.txn_id, a.category, a.merchant, a.amount AS observed, a.txn_id AS left_id,
  a.merchant || ' charged ' || {inr("a.amount")} || ' twice within ' || (b.txn_date - a.txn_date)
  || ' day(s). This may be a genuine repeat purchase, or a double charge worth checking.' AS reason
FROM l2 a JOIN l2 b ON b.tenant_id = a.tenant_id AND b.merchant = a.merchant AND b.amount = a.amount AND b.direction = a.direction
  AND b.txn_id <> a.txn_id AND b.txn_date > a.txn_date AND b.txn_date <= a.txn_date + 3
WHERE a.is_expense AND a.merchant IS NOT NULL""",
)
def duplicate_charges(spark, sf_dir):
    return N.duplicate_charges(S.events_ledger(spark, sf_dir))


@query("A10_median", f"{L3} SELECT tenant_id, round_even(percentile_cont(0.5) WITHIN GROUP (ORDER BY amount::DOUBLE), 4)::DECIMAL(18,4) AS median FROM l3 WHERE is_expense GROUP BY tenant_id")
def median(spark, sf_dir):
    rows = S.orders_ledger(spark, sf_dir).where("is_expense").groupBy("tenant_id")
    return rows.agg(F.bround(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY amount)"), 4).cast("decimal(18,4)").alias("median"))


@query(
    "A11_J5_first_seen_large",
    f"""{L3}, d AS (SELECT *, date_trunc('month', txn_date)::DATE AS month FROM l3), f AS (
  SELECT tenant_id, merchant, min(month) AS month FROM d WHERE merchant IS NOT NULL GROUP BY ALL
), fresh AS (SELECT d.* FROM d JOIN f USING (tenant_id, merchant, month) WHERE is_expense), m AS (
  SELECT p.tenant_id, p.month, round_even(median(d.amount::DOUBLE), 2)::DECIMAL(18,2) AS median
  FROM (SELECT DISTINCT tenant_id, month FROM fresh) p JOIN d ON d.tenant_id = p.tenant_id AND d.is_expense AND d.txn_date < last_day(p.month) GROUP BY ALL
)
SELECT tenant_id, month, 'merchant_first_large' AS kind, txn_date AS detected_on, txn_id, category, merchant, amount AS observed, median AS baseline,
  'First payment to ' || merchant || ', for ' || {inr("amount")} || ' — well above your typical transaction of ' || {inr("median")} || '.' AS reason
FROM fresh JOIN m USING (tenant_id, month) WHERE median > 0 AND amount >= median * 3""",
)
def first_seen_large(spark, sf_dir):
    return N.first_seen_large(S.orders_ledger(spark, sf_dir))


@query("A13_anomaly_sweep")
def sweep(spark, sf_dir):
    return N.sweep(W.kept(N.swept(S.lineitem_ledger(spark, sf_dir)), "swept"), W.kept)


@query(
    "A14_recurring_candidates",
    f"""{L3}, g AS (SELECT tenant_id, merchant, count(*) AS n, min(txn_date) AS first, max(txn_date) AS last
  FROM l3 WHERE is_expense AND txn_date >= DATE '1999-05-12' GROUP BY ALL HAVING count(*) >= 3), c AS (
  SELECT tenant_id, merchant, category, row_number() OVER (PARTITION BY tenant_id, merchant ORDER BY n DESC, category) AS r
  FROM (SELECT tenant_id, merchant, category, count(*) AS n FROM l3 WHERE is_expense AND txn_date >= DATE '1999-05-12' GROUP BY ALL))
SELECT tenant_id, merchant, n AS occurrence_count, first, last, category FROM g JOIN c USING (tenant_id, merchant) WHERE r = 1""",
)
def recurring_candidates(spark, sf_dir):
    rows = R.candidates(S.orders_ledger(spark, sf_dir), date(1999, 5, 12))
    return rows.withColumnsRenamed({"first_charge_on": "first", "last_charge_on": "last"})


SUBS = """g AS (SELECT tenant_id, merchant, list(txn_date ORDER BY txn_date, txn_id) AS days, list(amount ORDER BY txn_date, txn_id) AS amounts, count(*) AS n
  FROM l3 WHERE is_expense AND txn_date >= DATE '1990-01-01' GROUP BY ALL HAVING count(*) >= 3),
i AS (SELECT *, list_transform(range(2, n + 1), lambda k: days[k] - days[k - 1]) AS gaps, list_sort(amounts) AS a FROM g),
t AS (SELECT *, list_median(gaps)::DOUBLE AS gap FROM i),
u AS (SELECT *, round_even(CASE WHEN gap <= 0 THEN 0 ELSE greatest(0, 1 - list_sum(list_transform(gaps, lambda x: abs(x - gap))) / len(gaps) / gap) END, 3) AS stability,
  CASE WHEN abs(gap - 7) <= 2 THEN 'weekly' WHEN abs(gap - 14) <= 3 THEN 'fortnightly' WHEN abs(gap - 30) <= 5 THEN 'monthly'
       WHEN abs(gap - 91) <= 10 THEN 'quarterly' WHEN abs(gap - 182) <= 15 THEN 'half_yearly' WHEN abs(gap - 365) <= 25 THEN 'annual' END AS cadence,
  round_even((a[divide(n + 1, 2)::INT] + a[divide(n, 2)::INT + 1])::DECIMAL(20,4) * 0.5, 2)::DECIMAL(18,2) AS typical FROM t),
v AS (SELECT *, days[-1] AS last, CASE cadence WHEN 'monthly' THEN (days[-1] + INTERVAL 1 MONTH)::DATE WHEN 'quarterly' THEN (days[-1] + INTERVAL 3 MONTH)::DATE
  WHEN 'half_yearly' THEN (days[-1] + INTERVAL 6 MONTH)::DATE WHEN 'annual' THEN (days[-1] + INTERVAL 12 MONTH)::DATE ELSE days[-1] + floor(gap)::INT END AS next_on,
  CASE cadence WHEN 'weekly' THEN 52 WHEN 'fortnightly' THEN 26 WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 4 WHEN 'half_yearly' THEN 2 ELSE 1 END AS per_year
  FROM u WHERE cadence IS NOT NULL AND stability >= 0.8)"""
LOOKBACK = 365 * 12


def _subs(spark, sf_dir):
    return R.subscriptions(S.orders_ledger(spark, sf_dir), TODAY, (TODAY - date(1990, 1, 1)).days)


@query(
    "A15_A16_W5_F27_subscriptions",
    f"""{L3}, {SUBS.replace("list_median(gaps)::DOUBLE", "list_aggregate(gaps, 'median')::DOUBLE")} SELECT tenant_id, merchant, cadence, stability::DECIMAL(4,3) AS stability, typical AS typical_amount, amounts[-1] AS last_amount,
  (typical * per_year)::DECIMAL(18,2) AS estimated_annual_cost, days[1] AS first_charge_on, last AS last_charge_on, next_on AS next_expected_on,
  n AS occurrence_count, CASE WHEN next_on < DATE '2000-05-01' THEN 'lapsed' ELSE 'active' END AS status FROM v""",
)
def subscriptions(spark, sf_dir):
    return _subs(spark, sf_dir).drop("category", "account_id")


@query(
    "A17_recurring_load",
    f"""{L3}, {SUBS.replace("list_median(gaps)::DOUBLE", "list_aggregate(gaps, 'median')::DOUBLE")} SELECT tenant_id, count(*) AS n, sum(typical * per_year)::DECIMAL(18,2) AS annual,
  round_even(sum((typical * per_year)::DOUBLE / 12), 2)::DECIMAL(18,2) AS monthly_equivalent FROM v WHERE next_on >= DATE '2000-05-01' GROUP BY tenant_id""",
)
def recurring_load(spark, sf_dir):
    return R.recurring_load(_subs(spark, sf_dir))


@query(
    "A20_month_projection",
    f"""{L3}, {SUBS.replace("list_median(gaps)::DOUBLE", "list_aggregate(gaps, 'median')::DOUBLE")}, p AS (SELECT tenant_id, coalesce(sum(amount) FILTER (is_expense AND txn_date BETWEEN DATE '2000-06-01' AND DATE '2000-06-15'), 0)::DECIMAL(18,2) AS spent_so_far
  FROM l3 GROUP BY tenant_id), due AS (SELECT tenant_id, sum(typical) AS due FROM v
  WHERE next_on >= DATE '2000-05-01' AND next_on > DATE '2000-06-15' AND next_on <= DATE '2000-06-30' GROUP BY tenant_id), r AS (
  SELECT tenant_id, spent_so_far, round_even(spent_so_far::DOUBLE / 15 * 30, 2)::DECIMAL(18,2) AS run_rate_projection, coalesce(due, 0)::DECIMAL(18,2) AS upcoming_recurring
  FROM p LEFT JOIN due USING (tenant_id))
SELECT *, 15 AS days_elapsed, 30 AS days_in_month, greatest(run_rate_projection, spent_so_far + upcoming_recurring)::DECIMAL(18,2) AS projected_total, true AS reliable FROM r""",
)
def month_projection(spark, sf_dir):
    return R.project_month(S.orders_ledger(spark, sf_dir), _subs(spark, sf_dir), TODAY, TODAY)


def budgets(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("long").alias("tenant_id"), F.col("c_mktsegment").alias("category")).distinct()
    amount = (F.col("tenant_id") * 100_000 + F.length("category") * 10_000 + 50_000).cast("decimal(18,2)")
    return nations.select("tenant_id", "category", amount.alias("amount"), F.lit("0.80").cast("decimal(4,2)").alias("alert_threshold"), (F.col("tenant_id") % 7 != 3).alias("is_active"))


@query(
    "A21_J6_budget_progress",
    f"""{L3}, b AS (SELECT DISTINCT c_nationkey::BIGINT AS tenant_id, c_mktsegment AS category,
  (c_nationkey * 100000 + length(c_mktsegment) * 10000 + 50000)::DECIMAL(18,2) AS amount FROM customer WHERE c_nationkey % 7 <> 3), s AS (
  SELECT b.*, coalesce((SELECT sum(amount) FROM l3 WHERE is_expense AND l3.tenant_id = b.tenant_id AND l3.category = b.category
    AND txn_date BETWEEN DATE '2000-06-01' AND DATE '2000-06-30'), 0)::DECIMAL(18,2) AS spent FROM b), r AS (
  SELECT *, 0.80::DECIMAL(4,2) AS alert_threshold, true AS is_active, (amount - spent)::DECIMAL(18,2) AS remaining, round_even(spent::DOUBLE / amount::DOUBLE, 4)::DECIMAL(18,4) AS share_used,
    round_even(spent::DOUBLE * 2, 2)::DECIMAL(18,2) AS projected_total FROM s)
SELECT *, CASE WHEN share_used >= 1 THEN 'exceeded' WHEN share_used >= alert_threshold THEN 'warning' ELSE 'on_track' END AS state FROM r""",
)
def budget_progress(spark, sf_dir):
    return R.budget_progress(S.orders_ledger(spark, sf_dir), budgets(spark, sf_dir), TODAY, TODAY)


@query("A18_A19_insights")
def insights(spark, sf_dir):
    ledger = S.lineitem_ledger(spark, sf_dir)
    return I.monthly_insight(ledger, R.subscriptions(ledger, TODAY), MONTH)


@query(
    "U1_Q11_timeline",
    f"""WITH {S.STATEMENTS_SQL}, e AS (
  SELECT tenant_id, txn_date AS occurred_on, CASE WHEN amount >= 300000 THEN 'large_transaction' ELSE 'transaction' END AS kind, merchant AS title,
         category AS summary, amount, txn_id AS ref, direction AS detail FROM l3 WHERE is_expense
  UNION ALL
  SELECT tenant_id, period_end, 'statement_import', 'Account ' || account_id, document_type, NULL, statement_id::VARCHAR, NULL FROM l5_statements
)
SELECT * FROM e WHERE occurred_on BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' ORDER BY occurred_on DESC, kind, ref LIMIT 200""",
)
def timeline(spark, sf_dir):
    return I.timeline(S.orders_ledger(spark, sf_dir), S.statements(spark, sf_dir), date(1998, 1, 1), date(1998, 3, 31), 200, "300000")


FIRST_SEEN_SQL = ORACLE_SQL["A11_J5_first_seen_large"]
SUBSCRIPTIONS_SQL = ORACLE_SQL["A15_A16_W5_F27_subscriptions"]


@query(
    "U1_timeline_of_four",
    f"""WITH {S.STATEMENTS_SQL}, an AS ({FIRST_SEEN_SQL}), su AS ({SUBSCRIPTIONS_SQL}), e AS (
  SELECT tenant_id, txn_date AS occurred_on, CASE WHEN amount >= 300000 THEN 'large_transaction' ELSE 'transaction' END AS kind, merchant AS title,
         category AS summary, amount, txn_id AS ref, direction AS detail FROM l3 WHERE is_expense
  UNION ALL SELECT tenant_id, period_end, 'statement_import', 'Account ' || account_id, document_type, NULL, statement_id::VARCHAR, NULL FROM l5_statements
  UNION ALL SELECT tenant_id, detected_on, 'anomaly', merchant, reason, observed, txn_id, kind FROM an
  UNION ALL SELECT tenant_id, next_expected_on, 'subscription_renewal', merchant, 'Expected ' || cadence || ' charge', typical_amount, NULL, cadence FROM su WHERE status = 'active'
)
SELECT * FROM e WHERE occurred_on BETWEEN DATE '1998-01-01' AND DATE '2003-12-31'""",
)
def timeline_of_four(spark, sf_dir):
    ledger = S.orders_ledger(spark, sf_dir)
    return I.timeline(ledger, S.statements(spark, sf_dir), date(1998, 1, 1), date(2003, 12, 31), 2**31 - 1, "300000", N.first_seen_large(ledger), _subs(spark, sf_dir))
