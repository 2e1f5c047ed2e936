"""Records of calls to models, narratives, imports in numbers, and stored objects: over the given tables, with answers made of their columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import privacy as V
from ..operators import perimeter as P
from ..operators import reads as D
from ..operators import storage as B
from ..operators import trust as T
from ..sources import adapters as S
from ..streaming import tables as W
from .reads import _payloads
from .registry import ORACLE_SQL, query
from .trust import L5, REPORT

L3 = "WITH " + S.ORDERS_SQL


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _judged(spark, sf_dir):
    """A call per event: its category is of the event's type, its confidence of the number; some fail, and some answers hold an address."""
    k = F.col("event_id")
    slug = F.when(F.col("event_type") == "purchase", "shopping").when(F.col("event_type") == "view", "entertainment").otherwise(F.col("event_type"))
    note = F.when(k % 11 == 0, "write to a.b@example.org").otherwise("fine")
    answer = F.concat(F.lit('{"category":"'), slug, F.lit('","confidence":'), (k % 130 / 100).cast("decimal(4,2)").cast("string"), F.lit(',"reasoning":"'), note, F.lit('"}'))
    payload = F.create_map(F.lit("merchant"), F.when(k % 3 > 0, F.concat(F.lit("m"), (k % 100).cast("string"))), F.lit("direction"), F.lit("debit"))
    calls = _events(spark, sf_dir).select(
        k.alias("call_id"), F.col("user_id").alias("tenant_id"), F.lit(None).cast("string").alias("txn_id"), F.col("ts").cast("timestamp").alias("at"), F.lit("m-1").alias("model_name"),
        F.lit(None).cast("string").alias("model_version"), payload.alias("payload"), answer.alias("answer"), F.when(k % 7 == 0, "timeout").alias("error_code"),
        (k % 5000).alias("input_tokens"), (k % 700).alias("output_tokens"), F.lit(10).alias("latency_ms"), slug.alias("slug"),
    )
    return P.judged_calls(calls)


CALLS = """c AS (SELECT event_id AS k, user_id AS tenant_id, ts, CASE event_type WHEN 'purchase' THEN 'shopping' WHEN 'view' THEN 'entertainment' ELSE event_type END AS slug FROM events),
r AS (SELECT *, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 'pii_echo' WHEN slug NOT IN ('shopping', 'entertainment') THEN 'unknown_category' WHEN k % 130 > 100 THEN 'confidence_out_of_range' END AS rejected_by FROM c),
j AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'provider_error' WHEN rejected_by IS NOT NULL THEN 'output_rejected' ELSE 'ok' END AS outcome,
  round_even((k % 5000 * 250 + k % 700 * 1000)::DOUBLE / 1000000, 6)::DECIMAL(12,6) AS cost FROM r)"""


def _records(spark, sf_dir):
    judged = _judged(spark, sf_dir)
    categories = _judged(spark, sf_dir).select("slug").distinct().select("slug", F.length("slug").alias("category_id"))
    return P.call_records(judged, categories, "none", "250", "1000")


@query(
    "R9_call_records",
    f"""WITH {CALLS} SELECT k AS call_id, sha256('{{"direction":"debit"' || CASE WHEN k % 3 > 0 THEN ',"merchant":"m' || k % 100 || '"' ELSE '' END || '}}') AS payload_hash,
  CASE WHEN k % 3 > 0 THEN '["direction","merchant"]' ELSE '["direction"]' END AS fields_sent, CASE WHEN outcome = 'ok' THEN length(slug) END::INTEGER AS predicted_category_id,
  CASE WHEN outcome = 'ok' THEN k % 130 / 100 END::DECIMAL(5,4) AS predicted_confidence, outcome = 'ok' AS accepted, cost, outcome, CASE WHEN k % 7 = 0 THEN 'timeout' ELSE rejected_by END AS error_code FROM j""",
)
def call_records(spark, sf_dir):
    return _records(spark, sf_dir).select("call_id", "payload_hash", "fields_sent", "predicted_category_id", "predicted_confidence", "accepted", "cost", "outcome", "error_code")


@query(
    "R9_incidents",
    f"""WITH {CALLS} SELECT tenant_id, ts AS at, CASE rejected_by WHEN 'pii_echo' THEN 'output_pii_echo' ELSE 'output_schema_violation' END AS kind,
  CASE rejected_by WHEN 'pii_echo' THEN 'EMAIL' ELSE rejected_by END AS detector, '{{"stage":"categorize","outcome":"output_rejected"}}' AS context FROM j WHERE outcome = 'output_rejected'""",
)
def call_incidents(spark, sf_dir):
    return P.incident_records(_judged(spark, sf_dir), "categorize").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "R9_usage_by_day",
    f"""WITH {CALLS} SELECT tenant_id, ts::DATE AS day, count(*) AS calls, count(*) FILTER (outcome = 'ok') AS accepted, count(*) FILTER (outcome = 'output_rejected') AS outputs_rejected,
  sum(k % 5000)::BIGINT AS input_tokens, sum(k % 700)::BIGINT AS output_tokens, sum(cost)::DECIMAL(18,6) AS cost FROM j GROUP BY ALL""",
)
def usage_by_day(spark, sf_dir):
    return P.usage_by_day(_records(spark, sf_dir))


def _narratives(spark, sf_dir):
    """An answer per tenant and month of L3, which quotes its figures: rightly, one rupee more, with a link, or beside a call of a tool."""
    months = S.orders_ledger(spark, sf_dir).groupBy("tenant_id", F.date_format("txn_date", "yyyy-MM").alias("month"))
    rows = months.agg(F.round(F.sum("amount"), 0).cast("long").alias("rupees"), F.count("*").alias("n"))
    k = F.col("tenant_id") % 4
    quoted = F.col("rupees") + F.when(k == 1, 1).otherwise(0)
    text = F.concat(F.lit(" You spent ₹"), quoted.cast("string"), F.lit(" over "), F.col("n").cast("string"), F.lit(" payments"), F.when(k == 2, ", see www.shop").otherwise(""), F.lit(". "))
    view = F.create_map(F.lit("spending_rupees"), F.col("rupees").cast("string"), F.lit("transaction_count"), F.col("n").cast("string"))
    at = F.to_timestamp(F.concat("month", F.lit("-28 10:00:00")))
    return P.judged_narratives(rows.select("tenant_id", "month", at.alias("at"), view.alias("view"), text.alias("text"), F.when(k == 3, 1).alias("tool_calls"), F.when(F.col("month").endswith("-05"), "timeout").alias("error_code"), F.lit("m-1").alias("model_name")))


ANSWERS = """m AS (SELECT tenant_id, strftime(txn_date, '%Y-%m') AS month, round(sum(amount), 0)::BIGINT AS rupees, count(*) AS n FROM l3 GROUP BY ALL), a AS (
  SELECT *, CASE WHEN month LIKE '%-05' THEN 'provider_error' ELSE ['ok', 'untraceable_figure', 'output_rejected', 'output_rejected'][tenant_id % 4 + 1] END AS outcome FROM m)"""


@query(
    "R10_narrative_outcomes",
    f"""{L3}, {ANSWERS} SELECT tenant_id, month, outcome, CASE WHEN outcome = 'output_rejected' THEN CASE tenant_id % 4 WHEN 2 THEN 'url_in_output' ELSE 'unexpected_tool_call' END END AS rejected_by,
  CASE WHEN outcome = 'untraceable_figure' THEN 'currency' END AS detector FROM a""",
)
def narrative_outcomes(spark, sf_dir):
    return _narratives(spark, sf_dir).select("tenant_id", "month", "outcome", "rejected_by", "detector")


@query(
    "R10_stored_narratives",
    f"""{L3}, {ANSWERS} SELECT tenant_id, month, 'You spent ₹' || rupees || ' over ' || n || ' payments.' AS text, 'm-1' AS model_name, month || '-28T10:00:00' AS generated_at
FROM a WHERE outcome = 'ok' AND month < '1998-01'""",
)
def stored_narratives(spark, sf_dir):
    """The answers stored twice under one request's name, and an older round under another; snapshots end with 1997."""
    judged = _narratives(spark, sf_dir)
    snapshots = judged.where("month < '1998-01'").select("tenant_id", "month")
    path = W.shared_path(spark, "narratives")
    older = judged.withColumns({"at": F.col("at") - F.expr("interval 1 day"), "narrative": F.when(F.col("narrative").isNotNull(), "Older.")})
    for rows, request in ((judged, "second"), (older, "first"), (judged, "second")):
        P.store_narratives(rows, snapshots, path, request)
    return P.stored_narratives(spark.read.schema(P.NARRATIVES).parquet(path))


def _imports(spark, sf_dir):
    report = T.reconcile(S.statements(spark, sf_dir), S.statement_lines(spark, sf_dir))
    pages = S.statements(spark, sf_dir).select("statement_id", "page_count")
    return report.join(pages, "statement_id").withColumn("bank", F.concat(F.lit("BANK"), (F.col("account_id") % 5).cast("string")))


@query(
    "R13_import_metrics",
    f"""{L5}, {REPORT}, i AS (SELECT r.statement_id, 'BANK' || r.account_id % 5 AS bank, page_count, delta, trust_status FROM report r JOIN l5_statements USING (statement_id)),
u AS (SELECT 'pages_processed' AS metric, bank AS label, 'text' AS value, page_count AS n FROM i
  UNION ALL SELECT 'reconciliation_delta_paise', bank, CASE WHEN abs(delta) <= 0 THEN '0' WHEN abs(delta) <= 0.01 THEN '1' WHEN abs(delta) <= 1 THEN '100' WHEN abs(delta) <= 100 THEN '10000' ELSE 'over' END, 1 FROM i WHERE delta IS NOT NULL
  UNION ALL SELECT 'validation_failures', bank, 'reconciliation', 1 FROM i WHERE trust_status <> 'trusted'
  UNION ALL SELECT 'transactions_ingested', bank, review_status, 1 FROM l5_lines JOIN i USING (statement_id) WHERE review_status IS NOT NULL
  UNION ALL SELECT 'categorization', bank, CASE WHEN txn_id::BIGINT % 3 = 0 THEN 'user_rule' ELSE 'parser_rule' END, 1 FROM l5_lines JOIN i USING (statement_id) WHERE category IS NOT NULL)
SELECT metric, label, value, sum(n)::BIGINT AS n FROM u GROUP BY ALL""",
)
def import_metrics(spark, sf_dir):
    """Every third row with a category got it from a user's rule, the others from the parser's."""
    source = F.when(F.col("category").isNotNull(), F.when(F.col("txn_id").cast("long") % 3 == 0, "user_rule").otherwise("parser_rule"))
    return P.import_metrics(_imports(spark, sf_dir), S.statement_lines(spark, sf_dir).withColumn("category_source", source))


@query(
    "R13_import_messages",
    f"""{L5}, {REPORT}, n AS (SELECT statement_id, count(*) AS n FROM l5_lines GROUP BY ALL)
SELECT statement_id, CASE WHEN statement_id % 9 = 0 THEN 'Already imported — ' || n || ' duplicate rows skipped'
  ELSE n || ' transactions added · ' || CASE trust_status WHEN 'trusted' THEN 'reconciles exactly' WHEN 'untrusted' THEN 'does not reconcile' ELSE 'arithmetic could not be checked' END END AS message
FROM report JOIN n USING (statement_id)""",
)
def import_messages(spark, sf_dir):
    """Every ninth statement as one that was there already."""
    again = F.col("statement_id") % 9 == 0
    rows = S.statement_lines(spark, sf_dir).groupBy("statement_id").agg(F.count("*").alias("n"))
    message = P.import_message(F.when(again, 0).otherwise(F.col("n")), F.when(again, F.col("n")).otherwise(0), F.col("trust_status"))
    return _imports(spark, sf_dir).join(rows, "statement_id").select("statement_id", message.alias("message"))


SENT = ("merchant", "amount_bucket", "direction", "payment_method", "mcc_hint", "day_of_week")


@query(
    "R7_sent_fields",
    f"""WITH p AS (SELECT event_id FROM ({ORACLE_SQL["D7_payloads"]}) WHERE blocked_by IS NULL)
SELECT f.place, f.field, count(*) FILTER (f.field <> 'mcc_hint' OR event_id % 6 = 0) AS sent, count(*) FILTER (f.field = 'mcc_hint' AND event_id % 6 <> 0) AS withheld
FROM p, (VALUES {", ".join(f"({i}, '{f}')" for i, f in enumerate(SENT))}) f(place, field) GROUP BY ALL""",
)
def sent_fields(spark, sf_dir):
    sent, _, _ = V.checked_payload(F.col("p"))
    return P.sent_fields(_payloads(spark, sf_dir).select(sent.alias("payload")), list(SENT))


@query(
    "R15_sweep_objects",
    """SELECT 'job_events' AS frame, count(*) FILTER (ts::DATE < DATE '2024-01-16') AS removed, 0::BIGINT AS objects FROM events
UNION ALL SELECT 'statements', count(*) FILTER (o_orderkey % 3 = 0 AND o_orderdate::DATE < DATE '1996-01-31'), count(*) FILTER (o_orderkey % 3 = 0 AND o_orderdate::DATE < DATE '1996-01-31' AND o_orderkey % 4 <> 0) FROM orders""",
)
def sweep_objects(spark, sf_dir):
    """Orders as statements of all tenants, most of which have a stored object; the sweep runs twice."""
    key = F.when(F.col("o_orderkey") % 4 != 0, F.concat_ws("/", F.col("o_custkey") % 7, F.col("o_orderkey")))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    statements = orders.select((F.col("o_custkey") % 7).cast("long").alias("tenant_id"), key.alias("storage_key"), F.when(F.col("o_orderkey") % 3 == 0, F.to_date("o_orderdate")).alias("deleted_at"), F.year("o_orderdate").alias("year"))
    events = _events(spark, sf_dir).select("event_id", F.to_date("ts").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    tables = {n: B.StoredTable.write(rows, W.shared_path(spark, n), by) for n, rows, by in (("job_events", events, "day"), ("statements", statements, "year"))}
    windows = {"job_events": (tables["job_events"], "at", 15), "statements": (tables["statements"], "deleted_at", (date(2024, 1, 31) - date(1996, 1, 31)).days)}
    log = W.shared_path(spark, "object-sweeps")
    for _ in range(2):
        counts, keys = B.sweep_with_objects(spark, windows, "statements", "2024-01-31", log)
    objects = keys.agg(F.lit("statements").alias("frame"), F.count("*").alias("objects"))
    return counts.join(objects, "frame", "left").select("frame", "removed", F.coalesce("objects", F.lit(0)).cast("long").alias("objects"))


@query("R15_storage_keys", "SELECT o_orderkey, (o_custkey % 7) || '/' || o_orderkey AS storage_key FROM orders WHERE o_custkey % 7 = 3 AND o_orderkey % 4 <> 0")
def storage_keys(spark, sf_dir):
    key = F.when(F.col("o_orderkey") % 4 != 0, F.concat_ws("/", F.col("o_custkey") % 7, F.col("o_orderkey")))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 7).alias("tenant_id"), "o_orderkey", key.alias("storage_key"))
    return B.storage_keys(rows, 3).select("o_orderkey", "storage_key")


@query(
    "W4_balance_confidence",
    f"""{L5}, b AS (SELECT *, last_value(balance_after IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY source_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS printed FROM l5_lines),
w AS (SELECT *, coalesce(abs(balance_after - printed) <> amount, false) AS wrong FROM b)
SELECT statement_id, source_row, CASE WHEN wrong THEN 0.5 ELSE 0.9 END::DECIMAL(3,2) AS amount_confidence, CASE WHEN wrong THEN 0.5 ELSE 0.9 END::DECIMAL(3,2) AS direction_confidence,
  CASE WHEN wrong THEN 'balance_movement_mismatch' END AS warning FROM w""",
)
def balance_confidence(spark, sf_dir):
    return T.balance_movement(S.statement_lines(spark, sf_dir)).select("statement_id", "source_row", "amount_confidence", "direction_confidence", "warning")


@query(
    "R1_J7_listed_statements",
    f"""{L5}, c AS (SELECT statement_id, count(*) AS n FROM l5_lines WHERE statement_id % 17 <> 0 GROUP BY ALL),
j AS (SELECT user_id AS statement_id, arg_max(event_id, (ts, event_id)) AS job_id, arg_max(event_type, (ts, event_id)) AS job_state FROM events WHERE user_id IS NOT NULL GROUP BY ALL)
SELECT statement_id, page_count, c_name AS bank_name, c_mktsegment AS account_type, coalesce(n, 0) AS extracted_count, job_id, job_state, job_id % 100 AS progress
FROM l5_statements LEFT JOIN customer ON c_custkey = account_id LEFT JOIN c USING (statement_id) LEFT JOIN j USING (statement_id) WHERE statement_id % 19 <> 0""",
)
def listed_statements(spark, sf_dir):
    """Every event as a job of the statement that has its user's number; some statements are deleted, some have no health record."""
    k = F.col("statement_id")
    statements = S.statements(spark, sf_dir).withColumn("deleted_at", F.when(k % 19 == 0, F.lit("2024-01-01").cast("date")))
    accounts = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("bank_name"), F.col("c_mktsegment").alias("account_type"))
    extracted = S.statement_lines(spark, sf_dir).where(k % 17 != 0).groupBy("statement_id").agg(F.count("*").alias("extracted_count"))
    jobs = _events(spark, sf_dir).select(F.col("event_id").alias("job_id"), F.col("user_id").alias("statement_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("state"), (F.col("event_id") % 100).alias("progress"))
    rows = D.statement_list(statements, accounts, extracted, jobs)
    return rows.select("statement_id", "page_count", "bank_name", "account_type", "extracted_count", "job_id", "job_state", "progress")
