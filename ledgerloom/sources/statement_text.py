"""Reads statement text: masthead, parser choice, roles of table headers, rows of text, running-balance directions, metadata.

Documents are rows of (doc_id, pages) with pages as array<struct<page_number:int,text:string>>, or lines of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.narration import IFSC, LEADING_DATE, _let, collapse, parse_amount, parse_date

DISPATCH_FLOOR = 0.35
MASTHEAD_LINES = 20
# Rows that are no transactions, header words by role, and labels of printed figures.
NO_TRANSACTION = r"(?i)^\s*(?:b/?f|c/?f|brought forward|carried forward|opening balance|closing balance|total|grand total|page total|sub total)\b"
ROLES = {
    "date": ("date", "txn date", "transaction date", "posting date"),
    "value_date": ("value date", "value dt"),
    "description": ("description", "narration", "particulars", "details", "remarks", "transaction details"),
    "debit": ("debit", "withdrawal", "withdrawals", "dr", "withdrawal amt", "debit amount"),
    "credit": ("credit", "deposit", "deposits", "cr", "deposit amt", "credit amount"),
    "amount": ("amount", "transaction amount"),
    "balance": ("balance", "closing balance", "running balance"),
    "reference": ("ref no", "reference", "chq no", "cheque no", "chq ref no"),
}
MONEY = r"\(?-?(?:₹|Rs\.?\s*)?\d[\d,]*\.\d{2}\)?(?:\s*(?:[Cc][Rr]|[Dd][Rr])\.?)?-?"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no (over the whole document) and line, blank ones left out."""
    rows = docs.select("doc_id", F.posexplode("pages").alias("p", "page")).select("doc_id", "p", "page.page_number", F.posexplode(F.split("page.text", "\n")).alias("n", "line"))
    rows = rows.where(F.trim("line") != "")
    order = Window.partitionBy("doc_id").orderBy("p", "n")
    return rows.select("doc_id", "page_number", F.row_number().over(order).alias("line_no"), "line")


def masthead(docs: DataFrame) -> DataFrame:
    """doc_id and the first page's text before its first line that a date leads; the first 20 lines where that leaves under 3."""
    held = F.filter(F.split(F.get("pages", 0)["text"], "\n"), lambda x: F.trim(x) != "")
    rows = docs.select("doc_id", held.alias("held"))
    first = F.array_position(F.transform("held", lambda x: x.rlike(LEADING_DATE)), True)
    n = F.when(first > 3, (first - 1).cast("int")).otherwise(MASTHEAD_LINES)
    return rows.select("doc_id", F.array_join(F.slice("held", 1, n), "\n").alias("masthead"))


PARSERS = 1_000


def dispatch(docs: DataFrame, parsers: DataFrame) -> DataFrame:
    """The parser (code, signatures, ifsc_prefix, priority) of each document by its masthead: the best score of 0.35 or more, then the
    higher priority, then the code; the parser of priority 0 where none scores enough.

    Parsers are declarations, of which every document meets each; more than PARSERS of them are an error."""
    if parsers.limit(PARSERS + 1).count() > PARSERS:
        raise ValueError(f"more than {PARSERS} parsers")
    heads = masthead(docs).withColumn("lower", F.lower("masthead"))
    hits = F.aggregate("signatures", F.lit(0), lambda a, s: a + F.contains("lower", F.lower(s)).cast("int"))
    code = F.exists(F.regexp_extract_all("masthead", F.lit(IFSC), 0), lambda x: x.startswith(F.col("ifsc_prefix")))
    score = F.round(F.least(hits / F.greatest(F.size("signatures"), F.lit(1)), F.lit(1.0)) * 0.8 + F.when(code, 0.2).otherwise(0.0), 3)
    scored = heads.join(F.broadcast(parsers)).withColumn("score", score)
    scored = scored.where((F.col("score") >= DISPATCH_FLOOR) | (F.col("priority") == 0))
    enough = F.when(F.col("score") >= DISPATCH_FLOOR, F.col("score")).otherwise(-1.0)
    order = Window.partitionBy("doc_id").orderBy(F.desc(enough), F.desc("priority"), "code")
    return scored.withColumn("n", F.row_number().over(order)).where("n = 1").select("doc_id", "code", "score")


def header_roles(cells: Column) -> Column:
    """The role of each header cell: an exact word, else the longest contained; the first cell of a role has it."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(collapse(c)), "[^a-z ]+", " "))

    words = sorted(((w, r) for r, ws in ROLES.items() for w in ws), key=lambda x: (len(x[0]), x[0]))
    exact = F.create_map(*(F.lit(x) for pair in words for x in pair))

    def role(cell: Column) -> Column:
        within = F.lit(None).cast("string")
        for word, name in words:
            within = F.when(F.contains(cell, F.lit(word)), name).otherwise(within)
        return F.when(cell != "", F.coalesce(exact[cell], within))

    # Each step's value is computed once, however often the next one names it.
    roles = F.transform(F.transform(cells, flat), role)
    return _let(roles, lambda found: F.transform(found, lambda r, i: F.when(F.array_position(found, r) == i + 1, r)))


def usable(roles: Column) -> Column:
    """Whether a header names a date, a text and money."""
    money = F.array_contains(roles, "amount") | F.array_contains(roles, "debit") | F.array_contains(roles, "credit")
    return F.coalesce(F.array_contains(roles, "date") & F.array_contains(roles, "description") & money, F.lit(False))


def text_rows(docs: DataFrame, openings: DataFrame, year_hint: int | None = None) -> DataFrame:
    """Transactions of documents without tables, one per line that a date leads; later lines without date or money extend the narration.

    openings: doc_id and opening_balance. The last amount of a line is the balance where there are two or more. A row's
    direction is that of the change from the balance before; where the change is another amount, or nothing is printed,
    it is a debit of lower confidence. Rows that only carry totals forward are left out.
    """
    rows = lines(docs).withColumn("token", F.regexp_extract("line", LEADING_DATE, 1)).withColumn("amounts", F.regexp_extract_all("line", F.lit(MONEY), 0))
    rest = F.trim(F.regexp_replace(F.regexp_replace("line", LEADING_DATE, ""), MONEY, " "))
    rows = rows.withColumns({"day": F.when(F.col("token") != "", parse_date("token", year_hint)), "rest": F.regexp_replace(rest, r"\s+", " ")})
    rows = rows.where(~F.col("rest").rlike(NO_TRANSACTION))
    starts = F.col("day").isNotNull() & (F.size("amounts") > 0)
    rows = rows.withColumn("row", F.sum(starts.cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no")))
    rows = rows.where((F.col("row") > 0) & (starts | ((F.col("token") == "") & (F.size("amounts") == 0))))
    texts = F.array_sort(F.collect_list(F.struct("line_no", "rest")))
    one = rows.groupBy("doc_id", "row").agg(
        F.array_join(F.transform(texts, lambda t: t["rest"]), " ").alias("description"), F.min_by("page_number", "line_no").alias("source_page"),
        F.max("day").alias("txn_date"), F.max(F.when(starts, F.col("amounts"))).alias("amounts"),
    )
    value = lambda k: parse_amount(F.element_at("amounts", k))
    one = one.withColumns({"amount": F.abs(value(1)), "balance_after": F.when(F.size("amounts") > 1, value(-1))})
    before = F.last("balance_after", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    one = one.join(openings, "doc_id", "left").withColumn("change", F.col("balance_after") - F.coalesce(before, "opening_balance"))
    known = F.abs("change") == F.col("amount")
    return one.select(
        "doc_id", F.col("row").alias("source_row"), "source_page", "txn_date", F.trim("description").alias("description"), "amount",
        F.when(F.col("change") > 0, "credit").otherwise("debit").alias("direction"), "balance_after",
        F.when(F.coalesce(known, F.lit(False)), 0.99).otherwise(0.5).alias("direction_confidence"),
    )


def missing_balances(rows: DataFrame) -> DataFrame:
    """Opening and closing balance of each document from its first and last row with a printed balance."""
    printed = rows.where("balance_after is not null")
    moved = F.when(F.col("direction") == "debit", -F.col("amount")).otherwise(F.col("amount"))
    opening = F.min_by(F.col("balance_after") - moved, "source_row").cast("decimal(18,2)")
    return printed.groupBy("doc_id").agg(opening.alias("opening_balance"), F.max_by("balance_after", "source_row").alias("closing_balance"))


def metadata(text: Column) -> Column:
    """Period, last four digits and labelled figures that a statement's text prints."""
    day = r"(\d{1,2}[-/. ](?:\d{1,2}|[A-Za-z]{3,9})[-/. ]\d{2,4})"
    period = rf"(?i)(?:period|from|between)\s*:?\s*{day}\s*(?:to|-|and)\s*{day}"
    labelled = lambda label: parse_amount(F.nullif(F.regexp_extract(text, rf"(?i){label}\s*:?\s*({MONEY})", 1), F.lit("")))
    account = F.regexp_extract(text, r"(?i)(?:account|card)\s*(?:no|number)?\.?\s*:?\s*([Xx*\d][Xx*\d -]{3,24}\d)", 1)
    return F.struct(
        parse_date(F.nullif(F.regexp_extract(text, period, 1), F.lit(""))).alias("period_start"),
        parse_date(F.nullif(F.regexp_extract(text, period, 2), F.lit(""))).alias("period_end"),
        F.nullif(F.right(F.regexp_replace(account, r"\D", ""), F.lit(4)), F.lit("")).alias("last4"),
        labelled("opening balance").alias("opening_balance"), labelled("closing balance").alias("closing_balance"),
        labelled("total amount due").alias("total_amount_due"),
    )
