"""Reconciliation, fingerprints, confidence, transfers and changes to stored frames."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import maintenance as U
from ..operators import movement as J
from ..operators import trust as T
from ..sources import adapters as S
from .registry import query

L5 = "WITH " + S.STATEMENTS_SQL
REPORT = """w AS (
  SELECT l.*, s.opening_balance, s.period_start, s.period_end,
         balance_after IS NOT NULL AND balance_after <> coalesce(last_value(balance_after IGNORE NULLS) OVER (
           PARTITION BY statement_id ORDER BY source_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), opening_balance)
           + CASE direction WHEN 'debit' THEN -amount ELSE amount END AS breaks
  FROM l5_lines l JOIN l5_statements s USING (statement_id)
), a AS (
  SELECT statement_id, coalesce(sum(amount) FILTER (direction = 'debit'), 0)::DECIMAL(18,2) AS total_debits,
         coalesce(sum(amount) FILTER (direction = 'credit'), 0)::DECIMAL(18,2) AS total_credits, count(balance_after) AS printed,
         min(source_row) FILTER (breaks) AS bad, list_sort(list(DISTINCT source_page)) AS pages,
         count(*) FILTER (txn_date < period_start - 3 OR txn_date > period_end + 3) AS out_of_period
  FROM w GROUP BY statement_id
), r AS (
  SELECT s.tenant_id, s.account_id, s.statement_id, s.document_type, total_debits, total_credits,
    (opening_balance + CASE document_type WHEN 'credit_card_statement' THEN total_debits - total_credits ELSE total_credits - total_debits END - closing_balance)::DECIMAL(18,2) AS delta,
    printed >= 2 AS balance_checked, printed >= 2 AND bad IS NULL AS balance_continuous, CASE WHEN printed >= 2 THEN bad END AS first_divergent_row,
    list_filter(range(pages[1], pages[-1] + 1), lambda p: NOT list_contains(pages, p)) AS missing_pages, out_of_period
  FROM l5_statements s JOIN a USING (statement_id)
), report AS (
  SELECT *, CASE WHEN delta IS NULL THEN 'pending' WHEN delta = 0 THEN 'trusted' ELSE 'untrusted' END AS trust_status, len(missing_pages) = 0 AS pages_continuous FROM r
)"""


def _report(spark, sf_dir):
    return T.reconcile(S.statements(spark, sf_dir), S.statement_lines(spark, sf_dir))


@query("A23_A24_W2_P14_reconciliation", f"{L5}, {REPORT} SELECT * FROM report")
def reconciliation(spark, sf_dir):
    return _report(spark, sf_dir)


SCORE = """(CASE WHEN delta IS NULL THEN 0.80 WHEN delta <> 0 THEN 0.55 WHEN balance_checked AND balance_continuous THEN 0.99 WHEN balance_checked THEN 0.70 ELSE 0.97 END)"""


@query(
    "A25_F21_statement_health",
    f"""{L5}, {REPORT} SELECT statement_id, CASE WHEN delta IS NULL THEN 'warn' WHEN delta = 0 THEN 'pass' ELSE 'fail' END AS reconciliation,
  CASE WHEN NOT balance_checked THEN 'warn' WHEN balance_continuous THEN 'pass' ELSE 'fail' END AS running_balance,
  CASE WHEN pages_continuous THEN 'pass' ELSE 'warn' END AS pages, CASE WHEN out_of_period = 0 THEN 'pass' ELSE 'warn' END AS period,
  CASE WHEN pages_continuous THEN {SCORE} ELSE least({SCORE}, 0.70) END::DECIMAL(6,4) AS validation FROM report""",
)
def statement_health(spark, sf_dir):
    return T.health(_report(spark, sf_dir)).select("statement_id", "checks.*", "validation")


IDENTITY = "upper(merchant)"
PRINTS = f"""p AS (
  SELECT *, row_number() OVER (PARTITION BY statement_id, txn_date, amount, direction, upper(merchant) ORDER BY source_row) - 1 AS occurrence FROM l5_lines
), f AS (SELECT *, sha256(concat_ws('|', tenant_id, account_id, strftime(txn_date, '%Y-%m-%d'), amount, direction, upper(merchant), occurrence)) AS fingerprint FROM p)"""


def _prints(spark, sf_dir):
    return T.fingerprinted(S.statement_lines(spark, sf_dir), F.upper("merchant"))


@query("F18_W1_fingerprint", f"{L5}, {PRINTS} SELECT statement_id, source_row, occurrence, fingerprint FROM f")
def fingerprints(spark, sf_dir):
    return _prints(spark, sf_dir).select("statement_id", "source_row", "occurrence", "fingerprint")


ACCOUNT_KEY = b"key of the query"
_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in ACCOUNT_KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(
    "F19_account_fingerprint",
    f"""SELECT c_custkey, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(concat_ws(':', c_nationkey, c_mktsegment, 'savings', lpad(right(c_custkey::VARCHAR, 4), 4, '0')))))) AS fingerprint FROM customer""",
)
def account_fingerprints(spark, sf_dir):
    """Every customer as an account of its nation's tenant."""
    made = T.account_fingerprint(F.col("c_nationkey"), F.col("c_mktsegment"), F.lit("savings"), F.lpad(F.expr("right(cast(c_custkey as string), 4)"), 4, "0"), ACCOUNT_KEY)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", made.alias("fingerprint"))


@query("U3_new_rows", f"{L5}, {PRINTS} SELECT statement_id, source_row, fingerprint FROM f WHERE source_row > 3")
def new_rows(spark, sf_dir):
    rows = _prints(spark, sf_dir)
    again = rows.withColumn("statement_id", -F.col("statement_id"))  # the same statements, printed once more
    fresh = T.new_rows(rows.unionByName(again), rows.where("source_row <= 3"))
    return fresh.select(F.abs("statement_id").alias("statement_id"), "source_row", "fingerprint")


@query(
    "F22_F23_confidence",
    """WITH c AS (SELECT event_id, user_id % 7 AS u, event_id % 5 AS e, event_id % 11 AS o, value FROM events), s AS (
  SELECT event_id, (CASE WHEN e = 0 THEN 0.55 ELSE 0.99 END * CASE WHEN o = 0 THEN 0.92 ELSE 1 END)::DECIMAL(6,4) AS extraction,
    (0.30 + 0.11 * u)::DECIMAL(6,4) AS merchant,
    (CASE e WHEN 0 THEN 1.00 WHEN 1 THEN least(0.98, 0.30 + 0.11 * u) WHEN 2 THEN 0.97 WHEN 3 THEN 0.60 ELSE 0.60 END)::DECIMAL(6,4) AS category,
    (CASE WHEN o = 1 THEN 0.60 WHEN o = 2 THEN 0.85 ELSE 0.99 END)::DECIMAL(6,4) AS validation FROM c), m AS (
  SELECT *, least(extraction, merchant, category, validation) AS m FROM s)
SELECT event_id, extraction AS confidence_extraction, merchant AS confidence_merchant, category AS confidence_category, validation AS confidence_validation,
  CASE WHEN m >= 0.97 THEN 'auto_approved' WHEN m >= 0.90 THEN 'flagged' ELSE 'review_required' END AS review_status,
  CASE m WHEN extraction THEN 'extraction' WHEN merchant THEN 'merchant' WHEN category THEN 'category' ELSE 'validation' END AS weakest,
  round_even(m::DOUBLE, 3)::DECIMAL(4,3) AS confidence_min FROM m""",
)
def confidence(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    u, e, o = F.col("user_id") % 7, F.col("event_id") % 5, F.col("event_id") % 11
    source = F.element_at(F.array(*map(F.lit, ("user_rule", "verified_merchant_rule", "deterministic_rule", "fallback_other", "ai_model"))), (e + 1).cast("int"))
    rows = rows.select(
        "event_id",
        F.create_map(F.lit("date"), F.when(e == 0, 0.55).otherwise(0.99), F.lit("amount"), F.lit(1.0)).alias("field_confidence"),
        (F.lit("0.30").cast("decimal(6,4)") + F.lit("0.11").cast("decimal(6,4)") * u.cast("int")).alias("merchant_confidence"),
        source.alias("category_source"), F.when(e != 4, "x").alias("category_slug"), F.lit("0.99").alias("validation"), (o == 0).alias("from_ocr"),
        (o == 1).alias("suspected_duplicate"), (o == 2).alias("strictly_out_of_period"),
    )
    kept = ["event_id", "confidence_extraction", "confidence_merchant", "confidence_category", "confidence_validation", "review_status", "weakest", "confidence_min"]
    return T.confidence(rows).select(kept)


@query(
    "J10_transfer_pairs",
    f"""WITH RECURSIVE {S.ORDERS_SQL}, sent AS (
  SELECT tenant_id, txn_id, account_id, txn_date, 'debit' AS direction, ((txn_id::BIGINT % 5) * 100)::DECIMAL(18,2) AS amount FROM l3 WHERE movement_type = 'transfer'
), rows_ AS (
  SELECT 1 AS tenant_id, txn_id, account_id, txn_date, direction, amount FROM sent
  UNION ALL SELECT 1, 'm' || txn_id, -account_id, txn_date + (txn_id::BIGINT % 6)::INTEGER, 'credit', amount FROM sent
), edges AS (
  SELECT a.amount, a.txn_id AS a, b.txn_id AS b, abs(a.txn_date - b.txn_date) AS gap,
         row_number() OVER (PARTITION BY a.amount ORDER BY a.txn_date, a.txn_id, abs(a.txn_date - b.txn_date), b.txn_id) AS k
  FROM rows_ a JOIN rows_ b ON a.amount = b.amount AND a.direction <> b.direction AND a.account_id <> b.account_id AND abs(a.txn_date - b.txn_date) <= 3
), walk AS (
  SELECT amount, 0::BIGINT AS k, []::VARCHAR[] AS taken, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::BIGINT AS gap FROM (SELECT DISTINCT amount FROM edges)
  UNION ALL
  SELECT w.amount, e.k, CASE WHEN list_has_any(w.taken, [e.a, e.b]) THEN w.taken ELSE w.taken || [e.a, e.b] END,
         CASE WHEN NOT list_has_any(w.taken, [e.a, e.b]) THEN e.a END, e.b, e.gap
  FROM walk w JOIN edges e ON e.amount = w.amount AND e.k = w.k + 1
)
SELECT 1::BIGINT AS tenant_id, amount, a AS txn_id, b AS paired_with, gap::INTEGER AS gap_days FROM walk WHERE a IS NOT NULL""",
)
def transfer_pairs(spark, sf_dir):
    """All transfers as one tenant's and of five amounts, so that many compete."""
    ledger = S.mirrored_ledger(spark, sf_dir)
    key = F.regexp_replace("txn_id", "^m", "").cast("long")
    return J.pair_transfers(ledger.withColumns({"tenant_id": F.lit(1).cast("long"), "amount": (key % 5 * 100).cast("decimal(18,2)")}))


L3 = "WITH " + S.ORDERS_SQL


@query(
    "U6_U7_U8_corrections",
    f"""{L3}, c AS (SELECT *, txn_id::BIGINT % 10 = 0 AS hit FROM l3)
SELECT tenant_id, txn_id, CASE WHEN hit THEN 'FIXED' WHEN merchant = '1-1-URGENT' AND review_status NOT IN ('approved', 'corrected') THEN 'SIMILAR' ELSE category END AS category,
  CASE WHEN hit THEN 'corrected' WHEN trust_status = 'trusted' THEN 'approved' ELSE review_status END AS review_status FROM c""",
)
def corrections(spark, sf_dir):
    ledger = S.orders_ledger(spark, sf_dir)
    ledger = U.applied_to_similar(ledger, "1-1-URGENT", "SIMILAR")
    ledger = U.approved(ledger, F.col("trust_status") == "trusted")
    fixes = ledger.where(F.col("txn_id").cast("long") % 10 == 0).select("tenant_id", "txn_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    values = {c: F.lit(None).cast(dict(ledger.dtypes)[c]) for c in U.CORRECTABLE} | {"category": F.when(F.col("seq") == 1, "DRAFT").otherwise("FIXED")}
    return U.corrected(ledger, fixes.withColumns(values)).select("tenant_id", "txn_id", "category", "review_status")


@query(
    "U4_U5_upserts",
    """SELECT event_type, month, sum(n)::BIGINT AS n FROM (
  SELECT event_type, date_trunc('month', ts)::DATE AS month, 2 * count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY ALL
  UNION ALL SELECT event_type, date_trunc('month', ts)::DATE, 10 + count(*) FROM events WHERE event_type = 'click' GROUP BY ALL) GROUP BY ALL""",
)
def upserts(spark, sf_dir):
    counts = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(F.count("*").alias("n"))
    table = U.upsert(counts, counts.where("event_type = 'click'").withColumn("n", F.lit(10).cast("long")), ["event_type", "month"])
    return U.upsert_additive(table, counts, ["event_type", "month"])


@query(
    "U11_U12_retention",
    """SELECT 'events' AS frame, count(*) FILTER (ts::DATE < DATE '2024-01-16') AS removed FROM events
UNION ALL SELECT 'orders', count(*) FILTER (o_orderdate::DATE < DATE '1996-01-31') FROM orders""",
)
def retention(spark, sf_dir):
    events, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders"))
    today = date(2024, 1, 31)
    days = (today - date(1996, 1, 31)).days
    frames = {"events": (events.withColumn("d", F.to_date("ts")), "d", 15), "orders": (orders.withColumn("d", F.to_date("o_orderdate")), "d", days)}
    return U.retained(frames, today)[1]


@query(
    "U13_U14_orphans",
    """WITH o AS (SELECT o_custkey AS key FROM orders GROUP BY ALL), l AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 10 <> 0)
SELECT (SELECT count(*) FROM o) AS objects, (SELECT count(*) FROM o WHERE key NOT IN (SELECT key FROM l)) AS orphans,
  (SELECT count(*) FROM l) AS live, (SELECT count(*) FROM nation) AS tenants, NULL::VARCHAR AS refused""",
)
def orphans(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    objects = read("orders").select(F.col("o_custkey").alias("key")).distinct()
    return U.orphan_report(objects, read("customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("key")), read("nation"))
