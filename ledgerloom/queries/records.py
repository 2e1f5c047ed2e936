"""Audit entries, dimensions, log records, pages with totals and reads of one thing, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import safety as D
from ..operators import records as P
from ..sources import adapters as S
from ..streaming import tables as W
from ..streaming.jobs import TERMINAL
from .ledger import L1, WHICH, WHICH_SQL
from .registry import query

L3 = "WITH " + S.ORDERS_SQL


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "R17_audit_append",
    """SELECT event_id, user_id, event_type AS action, CASE WHEN event_id % 4 > 0 THEN left(repeat('ab', (event_id % 4)::INT * 60), 255) END AS user_agent,
  CASE event_id % 3 WHEN 0 THEN '{"count":"' || event_id || '"}' WHEN 1 THEN '{"count":"' || event_id || '","dropped_fields":"merchant"}' END AS details FROM events""",
)
def audit_append(spark, sf_dir):
    """Every event as an audited action, stored twice under one request's name."""
    k = F.col("event_id") % 3
    count = F.col("event_id").cast("string")
    details = F.when(k == 0, F.create_map(F.lit("count"), count)).when(k == 1, F.create_map(F.lit("merchant"), F.lit("x"), F.lit("count"), count))
    agent = F.repeat(F.lit("ab"), (F.col("event_id") % 4 * 60).cast("int"))
    actions = _read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("action"), agent.alias("user_agent"), F.lit(None).cast("boolean").alias("succeeded"), details.alias("details"))
    path = W.shared_path(spark, "audit")
    for _ in range(2):
        P.append_once(P.audit_entries(actions, ["count", "statement_id"]), path, "request-1")
    return spark.read.parquet(path).where("succeeded").select("event_id", "user_id", "action", "user_agent", "details")


@query(
    "U6_correction_audit",
    f"""{L3}, f AS (SELECT * FROM l3 WHERE txn_id::BIGINT % 10 = 0), c AS (
  SELECT tenant_id, txn_id, 1 AS seq, 'category' AS field, category AS old_value, 'DRAFT' AS new_value FROM f
  UNION ALL SELECT tenant_id, txn_id, 2, 'category', 'DRAFT', 'FIXED' FROM f
  UNION ALL SELECT tenant_id, txn_id, 2, 'is_expense', is_expense::VARCHAR, 'false' FROM f)
SELECT tenant_id, txn_id, seq::BIGINT AS seq, field, old_value, new_value FROM c WHERE old_value IS DISTINCT FROM new_value""",
)
def correction_audit(spark, sf_dir):
    from ..operators.maintenance import CORRECTABLE

    ledger = S.orders_ledger(spark, sf_dir)
    fixes = ledger.where(F.col("txn_id").cast("long") % 10 == 0).select("tenant_id", "txn_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    values = {c: F.lit(None).cast(dict(ledger.dtypes)[c]) for c in CORRECTABLE}
    values |= {"category": F.when(F.col("seq") == 1, "DRAFT").otherwise("FIXED"), "is_expense": F.when(F.col("seq") == 2, False)}
    return P.correction_entries(ledger, fixes.withColumns(values))


@query(
    "R16_dimension_build",
    """WITH c AS (SELECT 'c' || c_custkey AS slug, c_name AS name, c_mktsegment AS category, c_custkey FROM customer), a AS (
  SELECT c_custkey, upper(c_name) AS pattern FROM customer UNION SELECT c_custkey, upper(c_mktsegment) || ' ' || c_custkey FROM customer)
SELECT c.slug, c.name, c.category, count(*) AS aliases, min(greatest(1, 200 - length(a.pattern)))::INTEGER AS first_priority
FROM c JOIN a USING (c_custkey) GROUP BY ALL""",
)
def dimension_build(spark, sf_dir):
    """Customers as merchants: seeded with wrong names for some, then twice with the right ones."""
    rows = _read(spark, sf_dir, "customer")
    number = F.col("c_custkey").cast("string")
    aliases = F.array(F.concat(F.lit(" "), "c_name"), F.concat("c_mktsegment", F.lit(" "), number))
    seeds = rows.select(F.concat(F.lit("c"), number).alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), aliases.alias("aliases"))
    empty = seeds.limit(0).withColumn("id", F.lit(None).cast("string"))
    first = P.merged_dimension(empty, seeds.where("length(slug) % 2 = 0").withColumn("name", F.lit("old")), "merchant", ["slug"])
    table = P.merged_dimension(P.merged_dimension(first, seeds, "merchant", ["slug"]), seeds, "merchant", ["slug"])
    found = P.alias_rows(table).groupBy("merchant_id").agg(F.count("*").alias("aliases"), F.min("priority").alias("first_priority"))
    return table.drop("aliases").join(found, table["id"] == found["merchant_id"]).select("slug", "name", "category", "aliases", "first_priority")


@query("R18_log_records")
def log_records(spark, sf_dir):
    """Each conversation's turn as a log record: its text is scrubbed wherever it stands, and who speaks is not written."""
    nested = F.struct(F.array(F.coalesce("text", F.lit("")), F.lit("")).alias("seen"))
    record = F.to_json(F.struct(F.col("conv_id").cast("string").alias("request_id"), F.col("text").alias("event"), "role", nested.alias("exception"), F.lit(1).alias("count")))
    clean = D.log_record(["request_id", "event", "exception", "count"], ["request_id", "count"])
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", clean(record).alias("record"))


@query("P3_page_with_total", f"{L1} SELECT *, (SELECT count(*) FROM l1 WHERE {WHICH_SQL}) AS total FROM l1 WHERE {WHICH_SQL} ORDER BY txn_date DESC, txn_id DESC LIMIT 50 OFFSET 20")
def page_with_total(spark, sf_dir):
    rows = S.lineitem_ledger(spark, sf_dir).where(WHICH.column())
    return P.page_with_total(rows, [F.desc("txn_date"), F.desc("txn_id")], 50, 20)


@query("J2_known_categories", f"{L3} SELECT txn_id, category, 'Segment ' || lower(category) AS category_name FROM l3 WHERE category IN (SELECT c_mktsegment FROM customer WHERE c_mktsegment < 'H')")
def known_categories(spark, sf_dir):
    names = _read(spark, sf_dir, "customer").where("c_mktsegment < 'H'").select(F.col("c_mktsegment").alias("slug"), F.concat(F.lit("Segment "), F.lower("c_mktsegment")).alias("name")).distinct()
    return P.known_categories(S.orders_ledger(spark, sf_dir), names).select("txn_id", "category", "category_name")


@query(
    "R3_job_read",
    """SELECT user_id AS job_id, count(*) AS events, min(ts) AS started_at, arg_max(ts, event_id) AS updated_at, arg_max(CASE event_type WHEN 'purchase' THEN 'completed' ELSE event_type END, event_id) AS state,
  arg_max(event_type, event_id) = 'purchase' AS closed FROM events WHERE user_id = 7 GROUP BY user_id""",
)
def job_read(spark, sf_dir):
    state = F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))
    events = _read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("occurred_at"), state.alias("state"))
    return P.job_read(events, 7, TERMINAL)
