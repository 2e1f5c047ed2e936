"""Ledger analytics: filters, summaries, breakdowns, trends, comparisons and counts."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..operators import analytics as A
from ..sources import adapters as S
from .registry import query

L1 = "WITH " + S.LINEITEM_SQL
MONTH, BEFORE = date(1997, 6, 1), date(1997, 5, 1)
NET = """(expenses - refunds)::DECIMAL(18,2) AS net_expenses, (income - (expenses - refunds))::DECIMAL(18,2) AS net_cash_flow"""
SUMS = """coalesce(sum(amount) FILTER (is_expense), 0)::DECIMAL(18,2) AS expenses,
    coalesce(sum(amount) FILTER (movement_type IN ('income', 'salary') AND direction = 'credit'), 0)::DECIMAL(18,2) AS income,
    coalesce(sum(amount) FILTER (movement_type = 'refund'), 0)::DECIMAL(18,2) AS refunds"""
SUMMARY = f"""SELECT tenant_id, date_trunc('month', txn_date)::DATE AS month, {SUMS},
    coalesce(sum(amount) FILTER (movement_type IN ('transfer', 'credit_card_payment') AND direction = 'debit'), 0)::DECIMAL(18,2) AS transfers,
    count(*) AS transaction_count, count(*) FILTER (is_expense) AS expense_transaction_count,
    count(*) FILTER (trust_status IS DISTINCT FROM 'trusted') AS untrusted,
    count(*) FILTER (review_status = 'review_required') AS awaiting_review
  FROM l1 GROUP BY ALL"""
RATE = "CASE WHEN income > 0 THEN greatest(0, least(1, round_even((income - (expenses - refunds))::DOUBLE / income::DOUBLE, 4))) ELSE 0 END::DECIMAL(6,4)"


@query(
    "A1_monthly_summary",
    f"""{L1}, s AS ({SUMMARY})
SELECT *, untrusted = 0 AND awaiting_review = 0 AS fully_trusted, {NET}, {RATE} AS savings_rate FROM s""",
)
def monthly_summary(spark, sf_dir):
    return A.monthly_summary(S.lineitem_ledger(spark, sf_dir))


@query(
    "A2_data_quality",
    f"""{L1} SELECT tenant_id, count(*) AS transactions, count(*) FILTER (trust_status IS DISTINCT FROM 'trusted') AS untrusted,
 count(*) FILTER (review_status = 'review_required') AS awaiting_review FROM l1 GROUP BY tenant_id""",
)
def data_quality(spark, sf_dir):
    rows = A.monthly_summary(S.lineitem_ledger(spark, sf_dir)).groupBy("tenant_id")
    return rows.agg(F.sum("transaction_count").alias("transactions"), F.sum("untrusted").alias("untrusted"), F.sum("awaiting_review").alias("awaiting_review"))


@query(
    "A3_trend",
    f"""{L1}, spine AS (
  SELECT tenant_id, m::DATE AS month FROM (SELECT DISTINCT tenant_id FROM l1),
         unnest(generate_series(DATE '1995-07-01', DATE '1997-06-01', INTERVAL 1 MONTH)) AS u(m)
), s AS (SELECT tenant_id, date_trunc('month', txn_date)::DATE AS month, {SUMS}, count(*) AS n FROM l1 GROUP BY ALL
), f AS (SELECT tenant_id, month, coalesce(expenses, 0) AS expenses, coalesce(income, 0) AS income,
                coalesce(refunds, 0) AS refunds, coalesce(n, 0) AS transaction_count
         FROM spine LEFT JOIN s USING (tenant_id, month))
SELECT tenant_id, month, expenses, income, {NET}, transaction_count FROM f""",
)
def trend(spark, sf_dir):
    return A.trend(S.lineitem_ledger(spark, sf_dir), MONTH, 24)


BREAKDOWN = """SELECT tenant_id, date_trunc('month', txn_date)::DATE AS month, coalesce(category, 'uncategorised') AS slug,
    sum(amount)::DECIMAL(18,2) AS total, count(*) AS transaction_count FROM l1 WHERE is_expense GROUP BY ALL"""


@query(
    "A4_category_breakdown",
    f"""{L1}, s AS ({BREAKDOWN}), p AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, month ORDER BY total DESC, slug) AS place FROM s
)
SELECT *, round_even(total::DOUBLE / (sum(total) OVER (PARTITION BY tenant_id, month))::DOUBLE, 4)::DECIMAL(6,4) AS share
FROM p WHERE place <= 30""",
)
def category_breakdown(spark, sf_dir):
    return A.category_breakdown(S.lineitem_ledger(spark, sf_dir))


@query(
    "A5_daily_series",
    f"""{L1}, m AS (SELECT * FROM l1 WHERE txn_date BETWEEN DATE '1997-06-01' AND DATE '1997-06-30'), spine AS (
  SELECT tenant_id, d::DATE AS day FROM (SELECT DISTINCT tenant_id FROM m),
         unnest(generate_series(DATE '1997-06-01', DATE '1997-06-30', INTERVAL 1 DAY)) AS u(d)
), s AS (SELECT tenant_id, txn_date AS day, coalesce(sum(amount) FILTER (is_expense), 0) AS e, count(*) FILTER (is_expense) AS n FROM m GROUP BY ALL)
SELECT tenant_id, day, coalesce(e, 0)::DECIMAL(18,2) AS expenses, coalesce(n, 0) AS transaction_count
FROM spine LEFT JOIN s USING (tenant_id, day)""",
)
def daily_series(spark, sf_dir):
    return A.daily_series(S.lineitem_ledger(spark, sf_dir), MONTH)


@query(
    "A6_top_merchants",
    f"""{L1}, e AS (SELECT * FROM l1 WHERE is_expense AND merchant IS NOT NULL), m AS (
  SELECT tenant_id, merchant, sum(amount)::DECIMAL(18,2) AS total, count(*) AS transaction_count, max(txn_date) AS last_seen
  FROM e GROUP BY ALL
), c AS (
  SELECT tenant_id, merchant, category, row_number() OVER (PARTITION BY tenant_id, merchant ORDER BY n DESC, category) AS r
  FROM (SELECT tenant_id, merchant, category, count(*) AS n FROM e GROUP BY ALL)
), p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY total DESC, merchant) AS place FROM m)
SELECT p.*, c.category, round_even(total::DOUBLE / transaction_count, 2)::DECIMAL(18,2) AS average
FROM p JOIN c USING (tenant_id, merchant) WHERE r = 1 AND place <= 10""",
)
def top_merchants(spark, sf_dir):
    return A.top_merchants(S.lineitem_ledger(spark, sf_dir))


@query(
    "A7_compare_months",
    f"""{L1}, s AS ({BREAKDOWN}), p AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, month ORDER BY total DESC, slug) AS place FROM s
), a AS (SELECT tenant_id, slug, total FROM p WHERE month = DATE '1997-05-01' AND place <= 30
), b AS (SELECT tenant_id, slug, total FROM p WHERE month = DATE '1997-06-01' AND place <= 30
), j AS (SELECT tenant_id, slug, coalesce(a.total, 0)::DECIMAL(18,2) AS before, coalesce(b.total, 0)::DECIMAL(18,2) AS after
         FROM a FULL JOIN b USING (tenant_id, slug))
SELECT *, (after - before)::DECIMAL(18,2) AS change,
       CASE WHEN before > 0 THEN round_even((after - before)::DOUBLE / before::DOUBLE, 4) END::DECIMAL(18,4) AS percent_change FROM j""",
)
def compare_months(spark, sf_dir):
    return A.compare_months(S.lineitem_ledger(spark, sf_dir), BEFORE, MONTH)


@query(
    "A22_review_stats",
    f"""{L1} SELECT tenant_id, count(*) FILTER (review_status = 'review_required') AS review_required,
 count(*) FILTER (review_status = 'flagged') AS flagged, count(*) FILTER (review_status = 'auto_approved') AS auto_approved,
 count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status = 'corrected') AS corrected,
 count(*) AS total FROM l1 GROUP BY tenant_id""",
)
def review_stats(spark, sf_dir):
    return A.review_stats(S.lineitem_ledger(spark, sf_dir))


@query(
    "A28_J19_category_usage",
    f"""{L1} SELECT c.category, count(l1.category) AS n, coalesce(sum(amount) FILTER (is_expense), 0)::DECIMAL(18,2) AS spent
FROM (SELECT DISTINCT p_type AS category FROM part UNION SELECT 'UNUSED') c LEFT JOIN l1 USING (category) GROUP BY c.category""",
)
def category_usage(spark, sf_dir):
    kinds = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("category")).distinct()
    return A.category_usage(S.lineitem_ledger(spark, sf_dir), kinds.unionByName(spark.createDataFrame([("UNUSED",)], "category string")))


@query("A29_source_histogram", f"{L1} SELECT movement_type, count(*) AS n FROM l1 GROUP BY movement_type")
def source_histogram(spark, sf_dir):
    return S.lineitem_ledger(spark, sf_dir).groupBy("movement_type").agg(F.count("*").alias("n"))


@query(
    "A33_platform_gauges",
    f"{L1} SELECT count(DISTINCT tenant_id) AS tenants, count(DISTINCT account_id) AS accounts, count(*) AS transactions, "
    "count(*) FILTER (review_status = 'review_required') AS awaiting_review FROM l1",
)
def platform_gauges(spark, sf_dir):
    return S.lineitem_ledger(spark, sf_dir).agg(
        F.count_distinct("tenant_id").alias("tenants"), F.count_distinct("account_id").alias("accounts"), F.count("*").alias("transactions"),
        F.count_if(F.col("review_status") == "review_required").alias("awaiting_review"),
    )


@query(
    "A34_histogram",
    f"""{L1} SELECT CASE WHEN amount <= 1000 THEN 1000 WHEN amount <= 5000 THEN 5000 WHEN amount <= 20000 THEN 20000
 WHEN amount <= 50000 THEN 50000 END::DOUBLE AS edge, count(*) AS n FROM l1 GROUP BY ALL""",
)
def amount_histogram(spark, sf_dir):
    return A.histogram(S.lineitem_ledger(spark, sf_dir), F.col("amount"), [1000, 5000, 20000, 50000])


@query(
    "A35_top_with_other",
    f"""{L1}, s AS (SELECT tenant_id, category AS slug, sum(amount)::DECIMAL(18,2) AS total FROM l1 WHERE is_expense GROUP BY ALL), p AS (
  SELECT tenant_id, total, CASE WHEN row_number() OVER (PARTITION BY tenant_id ORDER BY total DESC, slug) <= 8 THEN slug ELSE 'Other' END AS slug FROM s)
SELECT tenant_id, slug, sum(total)::DECIMAL(18,2) AS total FROM p GROUP BY ALL""",
)
def top_with_other(spark, sf_dir):
    spent = S.lineitem_ledger(spark, sf_dir).where("is_expense").groupBy("tenant_id", F.col("category").alias("slug"))
    return A.fold_tail(spent.agg(F.sum("amount").cast("decimal(18,2)").alias("total")), ["tenant_id"], "slug", "total")


@query(
    "A26_account_coverage",
    f"""WITH {S.STATEMENTS_SQL} SELECT tenant_id, account_id, min(period_start) AS covers_from, max(period_end) AS covers_to,
 arg_max(closing_balance, (period_end, statement_id)) FILTER (closing_balance IS NOT NULL) AS balance, count(*) AS statements
FROM l5_statements GROUP BY ALL""",
)
def account_coverage(spark, sf_dir):
    return A.account_coverage(S.statements(spark, sf_dir))


@query(
    "A27_J8_account_counts",
    f"""WITH {S.STATEMENTS_SQL}, a AS (SELECT tenant_id, account_id, count(*) AS transactions FROM l3 GROUP BY ALL),
 b AS (SELECT tenant_id, account_id, count(*) AS statements FROM l5_statements GROUP BY ALL)
SELECT tenant_id, account_id, coalesce(transactions, 0) AS transactions, coalesce(statements, 0) AS statements
FROM a FULL JOIN b USING (tenant_id, account_id)""",
)
def account_counts(spark, sf_dir):
    return A.account_counts(S.orders_ledger(spark, sf_dir), S.statements(spark, sf_dir))


WHICH = A.LedgerFilter(date_from=date(1996, 1, 1), date_to=date(1997, 12, 31), merchant_like="supplier#0", direction="debit", is_expense=True, min_amount=Decimal("50000"))
WHICH_SQL = "txn_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND merchant ILIKE '%supplier#0%' AND direction = 'debit' AND is_expense AND amount >= 50000"


@query("P2_P3_O1_filtered_page", f"{L1} SELECT * FROM l1 WHERE {WHICH_SQL} ORDER BY txn_date DESC, txn_id DESC LIMIT 50 OFFSET 20")
def filtered_page(spark, sf_dir):
    return A.page(S.lineitem_ledger(spark, sf_dir), WHICH, 50, 20)


@query(
    "P4_filtered_totals",
    f"{L1} SELECT coalesce(sum(amount), 0)::DECIMAL(18,2) AS total, count(*) AS n, min(amount) AS least, max(amount) AS most FROM l1 WHERE {WHICH_SQL}",
)
def filtered_totals(spark, sf_dir):
    return A.totals(S.lineitem_ledger(spark, sf_dir), WHICH)


@query("P5_point_lookup", f"{L1} SELECT * FROM l1 WHERE txn_id = (SELECT min(txn_id) FROM l1 WHERE txn_id LIKE 'income-%')")
def point_lookup(spark, sf_dir):
    ledger = S.lineitem_ledger(spark, sf_dir)
    first = ledger.where("txn_id like 'income-%'").agg(F.min("txn_id").alias("txn_id"))
    return ledger.join(first, "txn_id", "left_semi")


@query(
    "P6_P7_month_bounds",
    f"""{L1} SELECT tenant_id, date_trunc('month', max(txn_date))::DATE AS first, last_day(max(txn_date)) AS last,
 (date_trunc('month', max(txn_date)) - INTERVAL 1 MONTH)::DATE AS previous FROM l1 GROUP BY tenant_id""",
)
def month_bounds(spark, sf_dir):
    latest = S.lineitem_ledger(spark, sf_dir).groupBy("tenant_id").agg(F.max("txn_date").alias("d"))
    first = F.trunc("d", "MM")
    return latest.select("tenant_id", first.alias("first"), F.last_day("d").alias("last"), F.add_months(first, -1).alias("previous"))


@query("P8_P9_predicates", f"{L1} SELECT tenant_id, count(*) AS n FROM l1 WHERE trust_status IS DISTINCT FROM 'trusted' AND movement_type IN ('refund', 'transfer') GROUP BY tenant_id")
def predicates(spark, sf_dir):
    rows = S.lineitem_ledger(spark, sf_dir).where(~F.col("trust_status").eqNullSafe("trusted") & F.col("movement_type").isin("refund", "transfer"))
    return rows.groupBy("tenant_id").agg(F.count("*").alias("n"))


@query("P10_json_field", "SELECT props::JSON ->> '$.k' AS k, count(*) AS n FROM events GROUP BY ALL")
def json_field(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("O3_largest_transaction", f"{L1}, p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY amount DESC, txn_id) AS r FROM l1 WHERE is_expense) SELECT tenant_id, txn_id, amount FROM p WHERE r = 1")
def largest_transaction(spark, sf_dir):
    best = F.min(F.struct((-F.col("amount")).alias("a"), "txn_id")).alias("best")
    rows = S.lineitem_ledger(spark, sf_dir).where("is_expense").groupBy("tenant_id").agg(best)
    return rows.select("tenant_id", "best.txn_id", (-F.col("best.a")).cast("decimal(18,2)").alias("amount"))


@query("O2_keyset_page", "SELECT event_id, ts, event_type, row_number() OVER (ORDER BY ts DESC, event_id DESC) = 51 AS more FROM events WHERE ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 51")
def keyset_page(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts < timestamp_ntz'2024-01-20'")
    rows = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(51)
    place = F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id")))
    return rows.select("event_id", "ts", "event_type", (place == 51).alias("more"))


@query(
    "F1_F2_F24_F25_money",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice::DECIMAL(18,2) AS amount, l_returnflag FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(amount, 0)::DECIMAL(18,0) AS whole,
  CASE l_returnflag WHEN 'R' THEN amount ELSE -amount END::DECIMAL(18,2) AS signed,
  CASE WHEN amount < 100 THEN 'under_100' WHEN amount < 500 THEN '100_500' WHEN amount < 1000 THEN '500_1000' WHEN amount < 5000 THEN '1000_5000'
       WHEN amount < 10000 THEN '5000_10000' WHEN amount < 50000 THEN '10000_50000' WHEN amount < 100000 THEN '50000_100000' ELSE 'over_100000' END AS bucket
FROM l""",
)
def money_functions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("amount", F.col("l_extendedprice").cast("decimal(18,2)"))
    rows = rows.withColumn("direction", F.when(F.col("l_returnflag") == "R", "credit").otherwise("debit"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.rupees("amount").alias("whole"), M.signed().alias("signed"), M.bucket("amount").alias("bucket")
    )
