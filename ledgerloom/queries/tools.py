"""The tools, the categorisation cascade, near duplicates, scorecards and document classification as queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import anomaly as N
from ..operators import categorize as C
from ..plans import tools as Q
from ..sources import adapters as S
from ..sources import statement_json as J
from ..streaming import tables as W
from .ledger import L1, NET, RATE, SUMMARY
from .registry import ORACLE_SQL, query

TOP_MERCHANTS_SQL, COMPARE_SQL = ORACLE_SQL["A6_top_merchants"], ORACLE_SQL["A7_compare_months"]

MONTH = date(1997, 6, 1)


@query("Q1_get_monthly_spending", f"""{L1}, s AS ({SUMMARY}) SELECT *, untrusted = 0 AND awaiting_review = 0 AS fully_trusted, {NET}, {RATE} AS savings_rate FROM s WHERE month = DATE '1997-05-01'""")
def q1(spark, sf_dir):
    return Q.get_monthly_spending(S.lineitem_ledger(spark, sf_dir), MONTH, "1997-05")


@query(
    "Q2_get_category_spending",
    f"""{L1}, s AS (SELECT tenant_id, category AS slug, sum(amount)::DECIMAL(18,2) AS total, count(*) AS transaction_count FROM l1
  WHERE is_expense AND year(txn_date) = 1997 GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY total DESC, slug) AS place FROM s), h AS (
  SELECT tenant_id, DATE '1997-01-01' AS month, slug, total, transaction_count, place,
    round_even(total::DOUBLE / (sum(total) OVER (PARTITION BY tenant_id))::DOUBLE, 4)::DECIMAL(6,4) AS share FROM p WHERE place <= 30)
SELECT * FROM h WHERE slug = 'PROMO'""",
)
def q2(spark, sf_dir):
    return Q.get_category_spending(S.lineitem_ledger(spark, sf_dir), MONTH, "1997", "PROMO")


@query("Q3_get_transactions", f"{L1} SELECT * FROM l1 WHERE txn_date BETWEEN DATE '1997-06-01' AND DATE '1997-06-30' AND merchant ILIKE '%supplier#00000001%' AND amount >= 20000 ORDER BY txn_date DESC, txn_id DESC LIMIT 25")
def q3(spark, sf_dir):
    return Q.get_transactions(S.lineitem_ledger(spark, sf_dir), MONTH, limit=25, merchant="supplier#00000001", min_amount=20000)


@query("Q4_get_top_merchants", TOP_MERCHANTS_SQL.replace("FROM l1 WHERE is_expense", "FROM l1 WHERE year(txn_date) = 1997 AND is_expense"))
def q4(spark, sf_dir):
    return Q.get_top_merchants(S.lineitem_ledger(spark, sf_dir), MONTH, "1997")


@query("Q5_get_recurring_expenses")
def q5(spark, sf_dir):
    return Q.get_recurring_expenses(S.orders_ledger(spark, sf_dir), date(2000, 6, 1))


@query("Q6_compare_months", f"SELECT *, slug = 'PROMO' AS in_focus FROM ({COMPARE_SQL}) WHERE change <> 0 ORDER BY abs(change) DESC, tenant_id, slug LIMIT 10")
def q6(spark, sf_dir):
    return Q.compare_months(S.lineitem_ledger(spark, sf_dir), MONTH, "1997-05", "1997-06", "PROMO")


@query("Q7_get_anomalies")
def q7(spark, sf_dir):
    return Q.get_anomalies(W.kept(N.swept(S.lineitem_ledger(spark, sf_dir)), "swept"), MONTH, keep=W.kept)


APRIL_TO_MAY = COMPARE_SQL.replace("1997-05-01", "1997-04-01").replace("1997-06-01", "1997-05-01")


@query("Q8_Q10_planned_question", f"SELECT *, slug = 'PROMO' AS in_focus FROM ({APRIL_TO_MAY}) WHERE change <> 0 ORDER BY abs(change) DESC, tenant_id, slug LIMIT 10")
def q8(spark, sf_dir):
    tool, arguments = Q.plan("Why did my spending on promo change from April to May 1997?", MONTH, {"PROMO": "Promo"}, [])
    return Q.execute(S.lineitem_ledger(spark, sf_dir), MONTH, tool, arguments)


def _cascade_rows(spark, sf_dir):
    key = F.col("txn_id").cast("long")
    return S.orders_ledger(spark, sf_dir).select(
        "tenant_id", "txn_id", "merchant", "amount", F.when(key % 3 != 0, F.col("category")).alias("category"), (key % 2 == 0).alias("is_verified"), F.lit("deterministic_rule").alias("category_source")
    )


RULES = [
    (1, "exact", "7-1-URGENT", None, None, 10, 1, "EXACT", True), (2, "contains", "-1-urg", 100000, None, 20, 1, "URGENT", True),
    (3, "contains", "-1-URGENT", 100000, None, 20, 2, "NEWER", True), (4, "contains", "low", None, 50000, 30, 1, "SMALL", True), (5, "contains", "-", None, None, 1, 9, "OFF", False),
]
#: Tenants of even number have all of these, tenant 1 one of its own, and the others none.
RULE_SCHEMA = "tenant_id long, rule_id int, match_type string, pattern string, min_amount int, max_amount int, priority int, created_seq int, category string, is_active boolean"
CASCADE = """r AS (SELECT tenant_id, txn_id, merchant, amount, CASE WHEN txn_id::BIGINT % 3 <> 0 THEN category END AS category, txn_id::BIGINT % 2 = 0 AS is_verified FROM l3),
h AS (SELECT tenant_id, merchant, category FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, merchant ORDER BY n DESC, category) AS k FROM (
  SELECT tenant_id, merchant, category, count(*) AS n FROM r WHERE is_verified AND category IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)) WHERE k = 1),
p AS (SELECT *, CASE WHEN tenant_id % 2 = 1 THEN CASE WHEN tenant_id = 1 AND contains(lower(merchant), 'low') THEN 'ONE' END WHEN lower(merchant) = '7-1-urgent' THEN 'EXACT' WHEN contains(lower(merchant), '-1-urgent') AND amount >= 100000 THEN 'NEWER'
  WHEN contains(lower(merchant), '-1-urg') AND amount >= 100000 THEN 'URGENT' WHEN contains(lower(merchant), 'low') AND amount <= 50000 THEN 'SMALL' END AS ruled
  FROM r WHERE NOT is_verified AND category IS NULL)"""


@query(
    "C2_C3_J12_J13_P11_cascade",
    f"""WITH {S.ORDERS_SQL}, {CASCADE} SELECT tenant_id, txn_id, coalesce(ruled, h.category) AS category,
 CASE WHEN ruled IS NOT NULL THEN 'user_rule' WHEN h.category IS NOT NULL THEN 'historical_pattern' ELSE 'open' END AS tier FROM p LEFT JOIN h USING (tenant_id, merchant)""",
)
def cascade(spark, sf_dir):
    return C.cascade(_cascade_rows(spark, sf_dir), rules(spark))


def rules(spark):
    own = [(1, 6, "contains", "low", None, None, 5, 1, "ONE", True)]
    return spark.createDataFrame([(t, *r) for t in range(0, 25, 2) for r in RULES] + own, RULE_SCHEMA)


@query(
    "C6_cascade_outcomes",
    f"""WITH {S.ORDERS_SQL}, {CASCADE} SELECT CASE WHEN ruled IS NOT NULL THEN 'user_rule' WHEN h.category IS NOT NULL THEN 'historical_pattern' ELSE 'open' END AS tier,
 count(*) AS n FROM p LEFT JOIN h USING (tenant_id, merchant) GROUP BY ALL""",
)
def cascade_outcomes(spark, sf_dir):
    return C.cascade_outcomes(cascade(spark, sf_dir))


@query(
    "C5_recategorised",
    f"""WITH {S.ORDERS_SQL}, {CASCADE}, d AS (SELECT tenant_id, txn_id, coalesce(ruled, h.category) AS category, CASE WHEN ruled IS NOT NULL THEN 'user_rule' WHEN h.category IS NOT NULL THEN 'historical_pattern' END AS tier,
   CASE WHEN ruled IS NOT NULL THEN 0.99 ELSE 0.90 END AS sure FROM p LEFT JOIN h USING (tenant_id, merchant)), e AS (SELECT * FROM d WHERE category IS NOT NULL),
 b AS (SELECT r.*, e.category AS new, e.tier, e.sure, CASE WHEN txn_id::BIGINT % 10 = 0 THEN 0.80 ELSE 0.98 END AS other FROM r LEFT JOIN e USING (tenant_id, txn_id))
SELECT tenant_id, txn_id, coalesce(new, category) AS category, coalesce(tier, 'deterministic_rule') AS category_source,
 CASE WHEN new IS NULL THEN 'flagged' WHEN least(other, sure) >= 0.97 THEN 'auto_approved' WHEN least(other, sure) >= 0.90 THEN 'flagged' ELSE 'review_required' END AS review_status FROM b""",
)
def recategorised(spark, sf_dir):
    rows = _cascade_rows(spark, sf_dir)
    score = lambda v: F.lit(v).cast("decimal(6,4)")
    rows = rows.withColumns(
        {
            "review_status": F.lit("flagged"), "confidence_category": score("0.60"), "confidence_extraction": F.when(F.col("txn_id").cast("long") % 10 == 0, score("0.80")).otherwise(score("0.98")),
            "confidence_merchant": score("0.99"), "confidence_validation": score("0.99"),
        }
    )
    decided = C.cascade(rows, rules(spark)).withColumn("confidence", F.when(F.col("tier") == "user_rule", score("0.99")).otherwise(score(C.HISTORY_CONFIDENCE)))
    return C.recategorised(rows, decided).select("tenant_id", "txn_id", "category", "category_source", "review_status")


@query(
    "U9_learned_rules",
    f"""WITH {S.ORDERS_SQL}, c AS (SELECT tenant_id, merchant, txn_id::BIGINT AS seq, category FROM l3 WHERE txn_id::BIGINT % 50 = 1 OR merchant = '7-1-URGENT'),
 k AS (SELECT tenant_id, lower(merchant) AS name, arg_max(category, seq) AS category, max(seq) AS seq, arg_max(merchant, seq) AS merchant FROM c GROUP BY ALL),
 o AS (SELECT t.tenant_id::BIGINT AS tenant_id, r.* FROM range(0, 25, 2) AS t(tenant_id), (VALUES (1, 'exact', '7-1-URGENT', 'EXACT', true), (2, 'contains', '-1-urg', 'URGENT', true),
   (3, 'contains', '-1-URGENT', 'NEWER', true), (4, 'contains', 'low', 'SMALL', true), (5, 'contains', '-', 'OFF', false)) AS r(rule_id, match_type, pattern, category, is_active)
   UNION ALL SELECT 1, 6, 'contains', 'low', 'ONE', true)
SELECT o.tenant_id, rule_id, match_type, pattern, coalesce(k.category, o.category) AS category, is_active OR k.category IS NOT NULL AS is_active
FROM o LEFT JOIN k ON k.tenant_id = o.tenant_id AND k.name = lower(o.pattern)
UNION ALL SELECT tenant_id, (6 + row_number() OVER (ORDER BY tenant_id, name))::INTEGER, 'exact', merchant, category, true FROM k
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.tenant_id = k.tenant_id AND lower(o.pattern) = k.name)""",
)
def learned_rules(spark, sf_dir):
    rows = S.orders_ledger(spark, sf_dir).withColumn("seq", F.col("txn_id").cast("int")).where("seq % 50 = 1 or merchant = '7-1-URGENT'")
    return C.learned_rules(rules(spark), rows.select("tenant_id", "seq", "merchant", "category")).select("tenant_id", "rule_id", "match_type", "pattern", "category", "is_active")


@query(
    "R4_rule_list",
    """WITH o AS (SELECT t.tenant_id::BIGINT AS tenant_id, r.* FROM range(0, 25, 2) AS t(tenant_id), (VALUES (1, 1, 'EXACT', true), (2, 1, 'URGENT', true), (3, 2, 'NEWER', true), (4, 1, 'SMALL', true), (5, 9, 'OFF', false)) AS r(rule_id, created_seq, category, is_active)
   UNION ALL SELECT 1, 6, 1, 'ONE', true)
SELECT tenant_id, rule_id, category, 'Category ' || category AS category_name, CASE WHEN category = 'EXACT' THEN 'Sub' END AS subcategory_name FROM o WHERE category <> 'OFF'""",
)
def rule_list(spark, sf_dir):
    names = spark.createDataFrame([(c, f"Category {c}") for c in ("EXACT", "URGENT", "NEWER", "SMALL", "ONE")], "slug string, name string")
    sub = rules(spark).withColumn("subcategory", F.when(F.col("category") == "EXACT", "sub"))
    listed = C.rule_list(sub, names, spark.createDataFrame([("sub", "Sub")], "slug string, name string"))
    return listed.select("tenant_id", "rule_id", "category", "category_name", "subcategory_name")


def _narrated(spark, sf_dir):
    ledger = S.orders_ledger(spark, sf_dir)
    return ledger.withColumns({"description": F.concat(F.lit("POS ORDER "), "merchant", F.lit(" AT SHOP")), "fingerprint": F.concat(F.lit("f"), "txn_id")})


@query("J11_F20_near_duplicates")
def near_duplicates(spark, sf_dir):
    ledger = _narrated(spark, sf_dir)
    again = ledger.withColumns({"txn_id": F.concat(F.lit("n"), "txn_id"), "fingerprint": F.concat(F.lit("g"), "txn_id"), "description": F.regexp_replace("description", "SHOP", "SHOPS")})
    return C.near_duplicates(again, ledger)


@query("A32_J20_scorecard")
def scorecard(spark, sf_dir):
    rows = _narrated(spark, sf_dir).withColumn("row", F.col("txn_id").cast("long"))
    truth = rows.select(F.col("account_id").cast("string").alias("fixture"), "row", "txn_date", "amount", "direction", "description", "merchant", "category")
    wrong = F.when(F.col("row") % 5 == 1, F.date_add("txn_date", 1)).otherwise(F.col("txn_date"))
    read = truth.where("row % 11 <> 0").withColumns({"txn_date": wrong, "category": F.when(F.col("row") % 7 == 0, "OTHER").otherwise(F.col("category"))})
    return C.scorecard(truth, read)


@query(
    "S5_document_classes",
    f"""WITH m AS (SELECT doc_id, {" + ".join(f"contains(lower(coalesce(text, '')), '{m}')::INT" for m in J.MARKERS["bank_statement"])} AS bank,
 {" + ".join(f"contains(lower(coalesce(text, '')), '{m}')::INT" for m in J.MARKERS["credit_card_statement"])} AS card FROM documents)
SELECT doc_id, CASE WHEN bank > card THEN 'bank_statement' WHEN card > bank THEN 'credit_card_statement' ELSE 'unknown' END AS kind,
 CASE WHEN bank + card = 0 THEN 0.0 WHEN bank = card THEN 0.5 ELSE round(greatest(bank, card) / (bank + card), 3) END::DOUBLE AS score FROM m""",
)
def document_classes(spark, sf_dir):
    kind, score = J.classify_document(F.coalesce("text", F.lit("")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", kind.alias("kind"), score.alias("score"))


@query("S20_content_hash_gate", "SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY sha256(html) ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def content_hash_gate(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return J.new_uploads(pages, "html", "page_id").select("page_id")
