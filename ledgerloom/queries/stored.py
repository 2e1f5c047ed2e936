"""Streams with keyed state, tables that streams and erasure keep, and sources: run over the given tables to their end."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import recurring as R
from ..operators import storage as B
from ..sources import adapters as S
from ..sources import canonical_source as C
from ..streaming import stateful as K
from ..streaming import tables as W
from .registry import query

L3 = "WITH " + S.ORDERS_SQL


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"ts": F.col("ts").cast("timestamp"), "event_id": F.col("event_id").cast("long")})


def _jobs(rows):
    """A job per user and day of the month, whose state is the event's type."""
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    return rows.select((F.col("user_id") * 100 + F.dayofmonth("ts")).cast("long").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("occurred_at"), state.alias("state"))


@query(
    "T1_job_follow",
    """WITH e AS (
  SELECT user_id * 100 + day(ts) AS job_id, event_id AS seq, ts AS occurred_at, hour(ts) < 8 AS old,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS state FROM events
), h AS (SELECT job_id, max(occurred_at) AS last, arg_max(state, (occurred_at, seq)) IN ('completed', 'failed', 'review_required') AS over FROM e WHERE old GROUP BY job_id),
n AS (SELECT e.job_id, e.seq, e.occurred_at, e.state FROM e LEFT JOIN h USING (job_id) WHERE NOT coalesce(over, false) AND NOT old AND (last IS NULL OR occurred_at > last)),
one AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY job_id, occurred_at ORDER BY seq) = 1),
cut AS (SELECT *, coalesce(sum((state IN ('completed', 'failed', 'review_required'))::INT) OVER (PARTITION BY job_id ORDER BY occurred_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM one),
shown AS (SELECT * FROM cut WHERE before = 0)
SELECT job_id, seq, occurred_at, state, 'event' AS kind FROM shown
UNION ALL SELECT job_id, seq, occurred_at, state, 'done' FROM shown WHERE state IN ('completed', 'failed', 'review_required')""",
)
def job_follow(spark, sf_dir):
    """Each day's events before 8 as history, the later ones as a stream. Jobs that go on show no timeout here: theirs runs for ten years."""
    jobs = _jobs(_events(spark, sf_dir))
    live = W.landed(jobs.where(F.hour("occurred_at") >= 8), "job-events")
    followed = K.followed_jobs(live, jobs.where(F.hour("occurred_at") < 8), timeout_ms=10 * 366 * 86_400_000, delay="60 days")
    return W.run_to_end(followed, W.shared_path(spark, "followed"), W.shared_path(spark, "followed-log"))


@query(
    "T2_W10_rate_decisions",
    """WITH e AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL), n AS (
  SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)
         - count(*) OVER (PARTITION BY user_id, us) + row_number() OVER (PARTITION BY user_id, us ORDER BY event_id) AS used FROM e)
SELECT event_id, used, used <= 3 AS allowed, greatest(3 - used, 0) AS remaining, CASE WHEN used <= 3 THEN 0 ELSE 86400 END AS retry_after_seconds FROM n""",
)
def rate_decisions(spark, sf_dir):
    rows = W.landed(_events(spark, sf_dir).where("ts is not null and user_id is not null").select("user_id", "event_id", "ts"), "requests")
    return W.run_to_end(K.rate_decisions(rows, "user_id", 3, 86_400), W.shared_path(spark, "decisions"), W.shared_path(spark, "decisions-log"))


@query(
    "T5_A19_snapshots",
    f"""{L3}, m AS (SELECT tenant_id, date_trunc('month', txn_date)::DATE AS period_month, sum(amount) FILTER (is_expense) AS spent, count(*) AS transaction_count,
  count(*) FILTER (review_status = 'review_required') AS unreviewed_count, count(*) FILTER (trust_status <> 'trusted') AS untrusted_count, arg_min(txn_id, (-amount, txn_id)) FILTER (is_expense) AS largest_transaction
  FROM l3 GROUP BY ALL), c AS (SELECT tenant_id, date_trunc('month', txn_date)::DATE AS period_month, category, sum(amount) AS total FROM l3 WHERE is_expense GROUP BY ALL),
d AS (SELECT period_month, tenant_id, arg_min(category, (-total, category)) AS largest_category FROM c GROUP BY ALL)
SELECT m.tenant_id, m.period_month, coalesce(spent, 0)::DECIMAL(18,2) AS total_expenses, m.transaction_count, m.unreviewed_count, m.untrusted_count, d.largest_category, m.largest_transaction
FROM m LEFT JOIN d USING (tenant_id, period_month) WHERE period_month BETWEEN DATE '1998-04-01' AND DATE '1998-06-01'""",
)
def snapshots(spark, sf_dir):
    """L3 as imports that arrive in files; each batch is stored and the three months up to June 1998 are rebuilt."""
    ledger, made = (W.shared_path(spark, n) for n in ("imported-ledger", "snapshots"))
    stream = W.landed(S.orders_ledger(spark, sf_dir), "imports")
    build = W.rebuild_after_import(ledger, made, R.subscriptions, date(1998, 6, 30))
    stream.writeStream.foreachBatch(build).option("checkpointLocation", W.shared_path(spark, "imports-log")).trigger(availableNow=True).start().awaitTermination()
    kept = ("tenant_id", "period_month", "total_expenses", "transaction_count", "unreviewed_count", "untrusted_count", "largest_category", "largest_transaction")
    return spark.read.parquet(made).withColumn("period_month", F.col("period_month").cast("date")).select(*kept)


@query("S25_ingestion_source", f"WITH {S.STATEMENTS_SQL} SELECT statement_id::VARCHAR AS fixture, (source_row - 1)::INTEGER AS source_row, txn_date, amount, direction, balance_after FROM l5_lines")
def ingestion_source(spark, sf_dir):
    """L5 as JSON lines in files, followed through the data source to their end."""
    lines = S.statement_lines(spark, sf_dir)
    text = {c: F.col(c).cast("string").alias(c) for c in ("txn_date", "amount", "direction", "balance_after")}
    shown = F.array_sort(F.collect_list(F.struct("source_row", F.struct(*text.values()).alias("t"))))
    whole = lines.groupBy(F.col("statement_id").cast("string").alias("fixture")).agg(F.transform(shown, lambda x: x["t"]).alias("transactions"))
    path = W.shared_path(spark, "canonical")
    whole.select(F.to_json(F.struct("fixture", "transactions")).alias("value")).write.text(path)
    spark.dataSource.register(C.CanonicalStatements)
    stream = spark.readStream.format("canonical_statements").option("pieceBytes", 100_000).load(path)
    rows = stream.select("fixture", "source_row", *(C.typed(c) for c in text))
    return W.run_to_end(rows, W.shared_path(spark, "ingested"), W.shared_path(spark, "ingested-log"))


def _stored(spark, sf_dir):
    """L3 by year and L5's statements by tenant, as stored tables."""
    ledger = S.orders_ledger(spark, sf_dir).withColumn("year", F.year("txn_date"))
    statements = S.statements(spark, sf_dir).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return B.StoredTable.write(ledger, W.shared_path(spark, "ledger"), "year"), B.StoredTable.write(statements, W.shared_path(spark, "statements"), "tenant_id")


@query(
    "U12_J18_tenant_erasure",
    f"""WITH {S.STATEMENTS_SQL}
SELECT 'transactions' AS frame, count(*) FILTER (tenant_id = 3) AS removed, count(*) FILTER (tenant_id <> 3) AS kept, count(DISTINCT tenant_id) FILTER (tenant_id <> 3) AS tenants FROM l3
UNION ALL SELECT 'statements', count(*) FILTER (tenant_id = 3), count(*) FILTER (tenant_id <> 3), count(DISTINCT tenant_id) FILTER (tenant_id <> 3) FROM l5_statements""",
)
def tenant_erasure(spark, sf_dir):
    ledger, statements = _stored(spark, sf_dir)
    tables = {"transactions": ledger, "statements": statements}
    removed = B.erase_tenant(spark, tables, 3, W.shared_path(spark, "erasure"), at_once=3)
    left = [t.read(spark).agg(F.lit(n).alias("frame"), F.count("*").alias("kept"), F.count_distinct("tenant_id").alias("tenants")) for n, t in tables.items()]
    return removed.join(left[0].unionByName(left[1]), "frame")


@query(
    "U13_soft_delete",
    f"""WITH {S.STATEMENTS_SQL}
SELECT s.statement_id, s.statement_id % 5 = 0 AS deleted, coalesce(count(l.txn_id) FILTER (s.statement_id % 5 <> 0), 0) AS transactions
FROM l5_statements s LEFT JOIN l3 l USING (statement_id) GROUP BY s.statement_id""",
)
def soft_delete(spark, sf_dir):
    ledger, statements = _stored(spark, sf_dir)
    gone = S.statements(spark, sf_dir).where("statement_id % 5 = 0").select("statement_id")
    B.soft_delete(spark, ledger, statements, gone, "2024-01-31 10:00:00", W.shared_path(spark, "soft-deletes"), "batch", at_once=4)
    counts = ledger.read(spark).groupBy("statement_id").agg(F.count("*").alias("n"))
    rows = statements.read(spark).join(counts, "statement_id", "left")
    return rows.select("statement_id", F.col("deleted_at").isNotNull().alias("deleted"), F.coalesce("n", F.lit(0)).alias("transactions"))


@query(
    "U11_four_windows",
    """SELECT 'job_events' AS frame, count(*) FILTER (ts::DATE < DATE '2024-01-16') AS removed FROM events
UNION ALL SELECT 'notifications', count(*) FILTER (event_id % 2 = 0 AND ts::DATE < DATE '2024-01-21') FROM events
UNION ALL SELECT 'audit_logs', count(*) FILTER (ts::DATE < DATE '2024-01-11') FROM events
UNION ALL SELECT 'statements', count(*) FILTER (o_orderkey % 3 = 0 AND o_orderdate::DATE < DATE '1996-01-31') FROM orders""",
)
def four_windows(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_id", F.to_date("ts").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.to_date("o_orderdate")).alias("deleted_at"), F.year("o_orderdate").alias("year"))
    frames = {
        "job_events": (events, "day", "at", 15), "notifications": (events.withColumn("at", F.when(F.col("event_id") % 2 == 0, F.col("at"))), "day", "at", 10),
        "audit_logs": (events, "day", "at", 20), "statements": (orders, "year", "deleted_at", (date(2024, 1, 31) - date(1996, 1, 31)).days),
    }
    windows = {n: (B.StoredTable.write(rows, W.shared_path(spark, n), by), column, days) for n, (rows, by, column, days) in frames.items()}
    return B.sweep(spark, windows, "2024-01-31", W.shared_path(spark, "sweeps"))
