"""Statements as tables and text: readers, parsers' choice, canonical JSON and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as S
from ..sources import statement_json as J
from ..sources import statement_tables as B
from ..sources import statement_text as X
from .registry import query

L5 = "WITH " + S.STATEMENTS_SQL


def _tables(spark, sf_dir, card: bool = False):
    """L5 printed as tables: each page of a statement is one, and only the first has a header. card: one amount column without marks."""
    rows = S.statement_lines(spark, sf_dir)
    money = lambda c: F.coalesce(F.format_number(c, 2), F.lit(""))
    out, into = (money(F.when(F.col("direction") == d, F.col("amount"))) for d in ("debit", "credit"))
    day, text = F.date_format("txn_date", "dd/MM/yyyy"), F.concat(F.lit("POS "), F.col("merchant"))
    cells = F.array(day, text, money(F.col("amount"))) if card else F.array(day, text, out, into, money(F.col("balance_after")))
    place = ["statement_id", "source_page", "source_row"]
    body = rows.select(*place, F.lit(1).alias("part"), cells.alias("cells"))
    more = rows.where("source_row % 4 = 1").select(*place, F.lit(2).alias("part"), F.array(F.lit(""), F.lit("REF MORE"), *[F.lit("")] * (1 if card else 3)).alias("cells"))
    head = ("Date", "Particulars", "Amount (INR)") if card else ("Txn Date", "Narration", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance")
    first = rows.where("source_row = 1").select(*place, F.lit(0).alias("part"), F.array(*map(F.lit, head)).alias("cells"))
    last = rows.groupBy("statement_id").agg(F.max("source_page").alias("source_page"), F.max("source_row").alias("source_row"))
    total = last.select(*place, F.lit(3).alias("part"), F.array(F.lit(""), F.lit("Grand Total"), *[F.lit("1.00")] * (1 if card else 3)).alias("cells"))
    printed = body.unionByName(more).unionByName(first).unionByName(total)
    row_no = F.col("source_row") * 4 + F.col("part")
    return printed.select(F.col("statement_id").alias("doc_id"), F.col("source_page").alias("page_number"), F.lit(0).alias("table_no"), row_no.alias("row_no"), "cells")


READ = """SELECT statement_id AS doc_id, source_page, source_row * 4 + 1 AS source_row, txn_date, 'POS ' || merchant || CASE WHEN source_row % 4 = 1 THEN ' REF MORE' ELSE '' END AS description, amount"""


@query("S9_S10_S12_S13_table_reader", f"{L5} {READ}, direction, balance_after FROM l5_lines")
def table_reader(spark, sf_dir):
    return B.table_rows(_tables(spark, sf_dir)).drop("value_date", "reference")


@query("S16_card_reader", f"{L5} {READ}, 'debit' AS direction, NULL::DECIMAL(18,2) AS balance_after FROM l5_lines")
def card_reader(spark, sf_dir):
    return B.table_rows(_tables(spark, sf_dir, card=True), card=True).drop("value_date", "reference")


@query(
    "S18_narration_check",
    f"""{L5}, r AS (SELECT txn_id, direction, CASE txn_id::BIGINT % 4 WHEN 0 THEN 'debit' WHEN 1 THEN 'credit' WHEN 2 THEN 'debit' END AS said FROM l5_lines)
SELECT txn_id, coalesce(said <> direction, false) AS conflict, CASE WHEN said <> direction THEN 0.55 ELSE 1.0 END::DOUBLE AS direction_confidence FROM r""",
)
def narration_check(spark, sf_dir):
    said = F.array(*map(F.lit, ("To Transfer X", "by  transfer-X", "BY CASH WDL", "POS X")))
    rows = S.statement_lines(spark, sf_dir).withColumn("description", F.get(said, (F.col("txn_id").cast("long") % 4).cast("int")))
    checked = B.narration_check(rows)
    return checked.select("txn_id", "conflict", F.col("direction_confidence").cast("double").alias("direction_confidence"))


@query(
    "S4_plausible_tables",
    f"""{L5}, t AS (SELECT statement_id, source_page, count(*) AS n FROM l5_lines GROUP BY ALL), c AS (
  SELECT statement_id AS doc_id, source_page AS page_number, 0 AS attempt, n FROM t WHERE statement_id % 2 = 0
  UNION ALL SELECT statement_id, source_page, 1, n FROM t), g AS (SELECT * FROM c WHERE n >= 2)
SELECT doc_id, page_number, min(attempt) AS attempt, any_value(n) AS rows FROM g GROUP BY doc_id, page_number""",
)
def plausible_tables(spark, sf_dir):
    rows = S.statement_lines(spark, sf_dir)
    cells = F.array(F.col("txn_id"), F.col("merchant"), F.lit(""))
    rows = rows.select(F.col("statement_id").alias("doc_id"), F.col("source_page").alias("page_number"), F.lit(0).alias("table_no"), F.col("source_row").alias("row_no"), cells.alias("cells"))
    thin = rows.withColumns({"attempt": F.lit(2), "cells": F.slice("cells", 1, 2)})
    both = rows.where("doc_id % 2 = 0").withColumn("attempt", F.lit(0)).unionByName(rows.withColumn("attempt", F.lit(1))).unionByName(thin)
    return B.plausible_tables(both).groupBy("doc_id", "page_number").agg(F.min("attempt").alias("attempt"), F.count("*").alias("rows"))


@query("S2_page_char_counts", "SELECT doc_id, length(trim(coalesce(text, ''), ' ')) AS n FROM documents")
def page_char_counts(spark, sf_dir):
    pages = F.array(F.struct(F.lit(1).alias("page_number"), F.col("text").alias("text")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.get(B.page_char_counts(pages), 0).alias("n"))


def _headed(spark, sf_dir):
    """A document for each order, whose masthead is one of five banks' by its key."""
    k = F.col("o_orderkey") % 5
    head = F.when(k == 0, "HDFC Bank Limited\nStatement of account").when(k == 1, "ICICI Bank Limited\nIFSC ICIC0001234\nDetailed statement").when(k == 2, "Yes Bank\nIFSC YESB0000001").when(k == 3, "A small bank\nwithout signature")
    text = F.concat(head.otherwise("Axis Bank Ltd\nAxis Bank Limited\nIFSC UTIB0000009"), F.lit("\nline\n01/02/2024 POS SHOP 1.00 2.00\nHDFC Bank Limited"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.array(F.struct(F.lit(1).alias("page_number"), text.alias("text"))).alias("pages"))


@query(
    "S6_S8_S17_bank_dispatch",
    """SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'hdfc_bank' WHEN 1 THEN 'icici_bank' WHEN 2 THEN 'yes_bank' WHEN 3 THEN 'generic_bank' ELSE 'axis_bank' END AS code,
  CASE o_orderkey % 5 WHEN 0 THEN 0.533 WHEN 1 THEN 0.733 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 ELSE 0.733 END::DOUBLE AS score FROM orders""",
)
def bank_dispatch(spark, sf_dir):
    return X.dispatch(_headed(spark, sf_dir), B.banks(spark, "bank_statement"))


@query(
    "S7_masthead",
    """SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 4 END AS lines FROM orders""",
)
def masthead(spark, sf_dir):
    return X.masthead(_headed(spark, sf_dir)).select("doc_id", F.size(F.split("masthead", "\n")).alias("lines"))


@query(
    "S14_metadata",
    """SELECT o_orderkey AS doc_id, o_orderdate::DATE AS period_start, o_orderdate::DATE + 30 AS period_end, lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS last4,
  o_totalprice::DECIMAL(18,2) AS opening_balance, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice::DECIMAL(18,2) END AS closing_balance FROM orders""",
)
def metadata(spark, sf_dir):
    day = lambda d: F.date_format(d, "dd/MM/yyyy")
    shown = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    number = F.concat(F.lit("Account No: XXXX XXXX "), F.lpad((F.col("o_custkey") % 10_000).cast("string"), 4, "0"))
    start = F.to_date("o_orderdate")
    text = F.concat_ws(
        "\n", number, F.concat(F.lit("Statement period "), day(start), F.lit(" to "), day(F.date_add(start, 30))), F.concat(F.lit("Opening Balance: ₹"), shown),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Closing balance "), shown)),
    )
    found = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), X.metadata(text).alias("m"))
    return found.select("doc_id", "m.period_start", "m.period_end", "m.last4", "m.opening_balance", "m.closing_balance")


@query(
    "S15_derived_balances",
    f"""{L5}, p AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY source_row) AS a, row_number() OVER (PARTITION BY statement_id ORDER BY source_row DESC) AS z FROM l5_lines WHERE balance_after IS NOT NULL)
SELECT statement_id AS doc_id, (max(balance_after - CASE direction WHEN 'debit' THEN -amount ELSE amount END) FILTER (a = 1))::DECIMAL(18,2) AS opening_balance, max(balance_after) FILTER (z = 1) AS closing_balance FROM p GROUP BY ALL""",
)
def derived_balances(spark, sf_dir):
    return X.missing_balances(S.statement_lines(spark, sf_dir).withColumnRenamed("statement_id", "doc_id"))


@query("S19_canonical_json", f"{L5} SELECT statement_id::VARCHAR AS fixture, (source_row - 1)::INTEGER AS source_row, txn_date, amount, direction, balance_after FROM l5_lines")
def canonical_json(spark, sf_dir):
    """L5 written as canonical statements (one JSON object a line, money as strings) and read back."""
    lines = S.statement_lines(spark, sf_dir)
    shown = F.struct("source_row", F.struct(F.col("txn_date").cast("string").alias("txn_date"), F.col("amount").cast("string").alias("amount"), "direction", F.col("balance_after").cast("string").alias("balance_after")).alias("t"))
    whole = lines.groupBy(F.col("statement_id").cast("string").alias("fixture")).agg(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["t"]).alias("transactions"))
    return J.statement_rows(J.parsed_statements(whole.select(F.to_json(F.struct("fixture", "transactions")).alias("json")))).select("fixture", "source_row", "txn_date", "amount", "direction", "balance_after")


@query("S21_O6_csv_export", "SELECT o_orderkey::VARCHAR AS txn_id, o_orderdate::DATE::VARCHAR AS txn_date, o_totalprice::DECIMAL(18,2)::VARCHAR AS amount, CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS is_verified FROM orders WHERE o_orderdate::DATE = DATE '1995-03-15'")
def csv_export(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("date(o_orderdate) = date '1995-03-15'")
    return J.csv_columns(J.gather_export(_exported(rows), cap=None))


@query("S22_S24_json_export", """SELECT '{"txn_id":"' || o_orderkey || '","txn_date":"' || o_orderdate::DATE || '","amount":"' || o_totalprice::DECIMAL(18,2) || '","is_verified":' || (o_orderstatus = 'F') || '}' AS line FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 3""")
def json_export(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("trunc(o_orderdate, 'MM') = date '1995-03-01'")
    return J.json_columns(J.gather_export(_exported(rows), cap=None)).select(F.to_json(F.struct("*")).alias("line"))


def _exported(rows):
    return rows.select(F.col("o_orderkey").cast("string").alias("txn_id"), F.to_date("o_orderdate").alias("txn_date"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), (F.col("o_orderstatus") == "F").alias("is_verified"))
