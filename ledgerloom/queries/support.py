"""Supporting reads: counters, semi joins, statement lists, projections by case, and statement text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import safety as D
from ..operators import reads as P
from ..sources import adapters as S
from ..sources import statement_text as X
from .ledger import L1
from .registry import query

L3 = "WITH " + S.ORDERS_SQL


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "A30_privacy_counters",
    """WITH d AS (SELECT ts::DATE AS day, count(*) AS calls FROM events GROUP BY ALL)
SELECT count(*) AS days, sum(calls)::BIGINT AS lifetime, (sum(calls) FILTER (day >= DATE '2024-01-15'))::BIGINT AS recent FROM d""",
)
def privacy_counters(spark, sf_dir):
    days = _read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"))
    recent = F.sum(F.when(F.col("day") >= F.lit("2024-01-15").cast("date"), F.col("calls")))
    return days.agg(F.count("*").alias("days"), F.sum("calls").alias("lifetime"), recent.alias("recent"))


@query(
    "R8_spend_against_ceiling",
    """SELECT coalesce(sum(round_even(abs(value), 2)::DECIMAL(18,2)), 0)::DECIMAL(18,6) AS spent, coalesce(sum(round_even(abs(value), 2)::DECIMAL(18,2)), 0) >= 40000 AS over_ceiling
FROM events WHERE date_trunc('month', ts)::DATE = DATE '2024-01-01'""",
)
def spend_against_ceiling(spark, sf_dir):
    calls = _read(spark, sf_dir, "events").select(F.to_date("ts").alias("at"), F.bround(F.abs("value"), 2).cast("decimal(18,2)").alias("cost"))
    return P.spend_against(calls, date(2024, 1, 15), "40000")


@query(
    "A31_business_merchants",
    f"""{L3}, known AS (SELECT DISTINCT c_custkey || '-1-urgent' AS name FROM customer WHERE c_custkey % 10 = 0), p AS (
  SELECT tenant_id, merchant, bool_and(CASE txn_id::BIGINT % 5 WHEN 0 THEN false WHEN 4 THEN NULL ELSE true END) AS by_rail FROM l3 GROUP BY ALL)
SELECT tenant_id, merchant, CASE WHEN lower(merchant) IN (SELECT name FROM known) THEN 'dictionary' ELSE 'rail' END AS by
FROM p WHERE by_rail OR lower(merchant) IN (SELECT name FROM known)""",
)
def business_merchants(spark, sf_dir):
    rails = F.array(*map(F.lit, ("upi", "card", "nach", "ach")))
    rail = F.get(rails, (F.col("txn_id").cast("long") % 5).cast("int"))
    known = _read(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.concat("c_custkey", F.lit("-1-URGENT")).alias("name"))
    return P.business_merchants(S.orders_ledger(spark, sf_dir).withColumn("rail", rail), known)


@query("A36_unread", "SELECT count(*) AS unread FROM events WHERE (user_id = 7 OR user_id IS NULL) AND event_type <> 'click'")
def unread(spark, sf_dir):
    return _read(spark, sf_dir, "events").where("(user_id = 7 or user_id is null) and event_type <> 'click'").agg(F.count("*").alias("unread"))


@query("J17_known_merchants", f"{L1} SELECT DISTINCT merchant FROM l1 WHERE lower(merchant) IN (SELECT lower(s_name) FROM supplier WHERE s_suppkey % 3 = 0)")
def known_merchants(spark, sf_dir):
    known = _read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.lower("s_name").alias("name"))
    rows = S.lineitem_ledger(spark, sf_dir).select("merchant").distinct()
    return rows.join(known, F.lower("merchant") == known["name"], "left_semi")


@query(
    "J1_J2_P1_projection",
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def projection(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("o_orderkey", "c_name", "n_name", "r_name")


@query(
    "R1_J7_statement_list",
    f"""WITH {S.STATEMENTS_SQL}, n AS (SELECT statement_id, count(*) AS ledger_rows, arg_max(txn_id, (txn_date, txn_id::BIGINT)) AS latest FROM l5_lines GROUP BY ALL)
SELECT statement_id, document_type, period_end, coalesce(ledger_rows, 0) AS ledger_rows, latest FROM l5_statements LEFT JOIN n USING (statement_id)""",
)
def statement_list(spark, sf_dir):
    rows = S.statement_lines(spark, sf_dir).groupBy("statement_id")
    rows = rows.agg(F.count("*").alias("ledger_rows"), F.max_by("txn_id", F.struct("txn_date", F.col("txn_id").cast("long"))).alias("latest"))
    whole = S.statements(spark, sf_dir).select("statement_id", "document_type", "period_end").join(rows, "statement_id", "left")
    return whole.withColumn("ledger_rows", F.coalesce("ledger_rows", F.lit(0)))


@query("R13_rows_per_page", f"WITH {S.STATEMENTS_SQL} SELECT statement_id, source_page, count(*) AS n FROM l5_lines GROUP BY ALL")
def rows_per_page(spark, sf_dir):
    return S.statement_lines(spark, sf_dir).groupBy("statement_id", "source_page").agg(F.count("*").alias("n"))


@query(
    "W3_W4_balance_direction",
    f"""WITH {S.STATEMENTS_SQL}, d AS (SELECT statement_id, source_row, amount, balance_after - lag(balance_after) OVER (PARTITION BY statement_id ORDER BY source_row) AS change FROM l5_lines)
SELECT statement_id, source_row, CASE WHEN change > 0 THEN 'credit' WHEN change < 0 THEN 'debit' END AS direction, abs(change) <> amount AS contradicts FROM d""",
)
def balance_direction(spark, sf_dir):
    order = Window.partitionBy("statement_id").orderBy("source_row")
    rows = S.statement_lines(spark, sf_dir).withColumn("change", F.col("balance_after") - F.lag("balance_after").over(order))
    way = F.when(F.col("change") > 0, "credit").when(F.col("change") < 0, "debit")
    return rows.select("statement_id", "source_row", way.alias("direction"), (F.abs("change") != F.col("amount")).alias("contradicts"))


@query("F26_weekdays", f"{L3} SELECT ['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'][isodow(txn_date)] AS day, count(*) AS n FROM l3 GROUP BY ALL")
def weekdays(spark, sf_dir):
    names = F.array(*map(F.lit, ("mon", "tue", "wed", "thu", "fri", "sat", "sun")))
    return S.orders_ledger(spark, sf_dir).groupBy(F.get(names, F.weekday("txn_date")).alias("day")).agg(F.count("*").alias("n"))


@query("F33_cost_estimate", "SELECT event_id, round_even((event_id % 5000 * 250 + event_id % 700 * 1000)::DOUBLE / 1000000, 6)::DECIMAL(12,6) AS cost FROM events")
def cost_estimate(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", M.cost_estimate(F.col("event_id") % 5000, F.col("event_id") % 700, 250, 1000).alias("cost"))


@query("F34_payload_hash", "SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS hash FROM events")
def payload_hash(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("hash"))


@query("O4_O5_orderings", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY abs(o_totalprice - 250000) NULLS LAST, o_orderkey LIMIT 40")
def orderings(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.abs(F.col("o_totalprice") - 250000).asc_nulls_last(), "o_orderkey").limit(40)


@query(
    "D6_sendable_merchants",
    """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN false WHEN event_id % 5 = 0 THEN true ELSE CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN event_id % 3 = 0 ELSE false END END AS sendable FROM events""",
)
def sendable_merchants(spark, sf_dir):
    k = F.col("event_id")
    rail = F.element_at(F.array(*map(F.lit, ("imps", "card", "upi", "netbanking"))), (k % 4 + 1).cast("int"))
    text = F.when(k % 3 == 0, "UPI/P2M/SHOP").otherwise("UPI/P2A/SOMEBODY")
    return _read(spark, sf_dir, "events").select("event_id", D.merchant_sendable(F.when(k % 13 != 0, "SHOP"), k % 5 == 0, rail, text).alias("sendable"))


@query("D12_audit_details", "SELECT event_id, event_type, 'props' AS dropped FROM events")
def audit_details(spark, sf_dir):
    details = F.create_map(F.lit("event_type"), "event_type", F.lit("props"), "props")
    kept, dropped = D.allowed_details(details, ["event_type"])
    return _read(spark, sf_dir, "events").select("event_id", kept["event_type"].alias("event_type"), F.array_join(dropped, ",").alias("dropped"))


PARSERS = [("even", ["bank of even accounts"], "EVEN", 10), ("generic", ["statement of account"], "GNRC", 0)]
PARSER_SCHEMA = "code string, signatures array<string>, ifsc_prefix string, priority int"


@query("S7_S8_S11_S12_S14_statement_text")
def statement_text(spark, sf_dir):
    """Statements printed as text from L5 and read back: the rows' dates, amounts and directions, and the mastheads' parser and figures."""
    rows = S.statement_lines(spark, sf_dir)
    line = F.concat_ws(" ", F.date_format("txn_date", "dd/MM/yyyy"), F.lit("POS"), "merchant", F.format_number("amount", 2), F.format_number("running", 2))
    order = F.array_sort(F.collect_list(F.struct("source_row", line.alias("line"))))
    account, day = F.max("account_id"), lambda d: F.date_format(d, "dd/MM/yyyy")
    bank = F.when(account % 2 == 0, "Bank of Even Accounts\nBranch X EVEN0001234").otherwise("Statement of account\nBranch X")
    number = F.concat(F.lit("Account no: XXXX"), F.lpad((account % 10_000).cast("string"), 4, "0"))
    period = F.concat(F.lit("Period: "), day(F.min("txn_date")), F.lit(" to "), day(F.max("txn_date")))
    text = F.concat_ws("\n", bank, number, period, F.lit("Opening balance: 0.00"), F.array_join(F.transform(order, lambda x: x["line"]), "\n"))
    docs = rows.groupBy(F.col("statement_id").alias("doc_id")).agg(F.array(F.struct(F.lit(1).alias("page_number"), text.alias("text"))).alias("pages"))
    heads = X.masthead(docs).select("doc_id", "masthead", X.metadata(F.col("masthead")).alias("m"))
    opening = heads.select("doc_id", F.col("m.opening_balance").cast("decimal(18,2)").alias("opening_balance"))
    printed = heads.select("doc_id", F.size(F.split("masthead", "\n")).alias("masthead_lines"), "m.period_start", "m.period_end", "m.last4", "m.opening_balance")
    parser = X.dispatch(docs, spark.createDataFrame(PARSERS, PARSER_SCHEMA)).select("doc_id", F.col("code").alias("parser"), F.col("score").alias("parser_score"))
    return X.text_rows(docs, opening).join(parser, "doc_id").join(printed, "doc_id")
