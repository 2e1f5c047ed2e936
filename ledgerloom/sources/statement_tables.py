"""Reads statement tables: plausible grids, headers carried over pages, positional rows, banks' and cards' variants.

Tables are rows of cells: doc_id, page_number, table_no, row_no (each from 0 or 1 on, in order) and cells (array of string).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.narration import amount_direction, collapse, parse_amount, parse_date
from .statement_text import NO_TRANSACTION, header_roles, usable

LEAST_ROWS, LEAST_COLUMNS = 2, 3
#: Rows of a table among which its header is looked for.
HEADER_ROWS = 4
# The parsers by code, name, kind of document, signatures, prefix of branch codes and priority.
BANKS = (
    ("hdfc_bank", "HDFC", "HDFC Bank", "bank_statement", ("hdfc bank limited", "hdfc bank ltd", "statement of account"), "HDFC", 100),
    ("icici_bank", "ICICI", "ICICI Bank", "bank_statement", ("icici bank limited", "detailed statement", "transaction remarks"), "ICIC", 100),
    ("axis_bank", "AXIS", "Axis Bank", "bank_statement", ("axis bank ltd", "axis bank limited", "statement of account"), "UTIB", 100),
    ("sbi_bank", "SBI", "State Bank of India", "bank_statement", ("state bank of india", "account statement"), "SBIN", 100),
    ("kotak_bank", "KOTAK", "Kotak Mahindra Bank", "bank_statement", ("kotak mahindra bank",), "KKBK", 50),
    ("idfc_bank", "IDFC", "IDFC FIRST Bank", "bank_statement", ("idfc first bank",), "IDFB", 50),
    ("indusind_bank", "INDUSIND", "IndusInd Bank", "bank_statement", ("indusind bank",), "INDB", 50),
    ("yes_bank", "YES", "Yes Bank", "bank_statement", ("yes bank",), "YESB", 50),
    ("hdfc_card", "HDFC", "HDFC Bank Credit Card", "credit_card_statement", ("hdfc bank limited", "credit card statement"), "HDFC", 100),
    ("icici_card", "ICICI", "ICICI Bank Credit Card", "credit_card_statement", ("icici bank limited", "credit card statement"), "ICIC", 100),
    ("generic_bank", "GENERIC", "Unidentified bank", "bank_statement", (), None, 0),
    ("generic_card", "GENERIC", "Unidentified card issuer", "credit_card_statement", (), None, 0),
)
BANK_SCHEMA = "code string, bank_code string, bank_name string, document_type string, signatures array<string>, ifsc_prefix string, priority int"
# Openings of narrations that say which way money went.
GOES_OUT = r"(?i)^\s*(?:TO\s+TRANSFER|TO\s+ATM|TO\s+CHEQUE|BY\s+CASH\s+WDL|BY\s+DEBIT\s+CARD)"
COMES_IN = r"(?i)^\s*(?:BY\s+TRANSFER|BY\s+CASH\s+DEP|BY\s+CLEARING)"


def banks(spark: SparkSession, document_type: str | None = None) -> DataFrame:
    """The parsers' declarations; those of one kind of document where one is named."""
    rows = [b for b in BANKS if document_type in (None, b[3])]
    return spark.createDataFrame([(*b[:4], list(b[4]), *b[5:]) for b in rows], BANK_SCHEMA)


def page_char_counts(pages: Column) -> Column:
    """The number of characters of each page's text, blanks around it aside."""
    return F.transform(pages, lambda p: F.char_length(F.trim(F.coalesce(p["text"], F.lit("")))))


def plausible_tables(candidates: DataFrame) -> DataFrame:
    """Of candidates (tables with attempt, the strategy's place in the cascade) the plausible ones of each page's first attempt that has any.

    A plausible table has two rows, three columns in some row, and as many filled cells as rows.
    """
    key = ["doc_id", "page_number", "attempt", "table_no"]
    filled = F.size(F.filter("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    shape = candidates.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.size("cells")).alias("wide"), F.sum(filled).alias("filled"))
    good = shape.where((F.col("n") >= LEAST_ROWS) & (F.col("wide") >= LEAST_COLUMNS) & (F.col("filled") >= F.col("n"))).select(key)
    first = good.groupBy("doc_id", "page_number").agg(F.min("attempt").alias("attempt"))
    return candidates.join(good.join(first, ["doc_id", "page_number", "attempt"], "left_semi"), key, "left_semi")


def table_rows(tables: DataFrame, year_hint: int | None = None, card: bool = False) -> DataFrame:
    """The transactions of tables: doc_id, source_page, source_row, txn_date, value_date, description, amount, direction, balance_after, reference.

    A table's header is the first of its first rows that names a date, a text and money; a table without one goes by the
    last header before it, and rows before any header are left out. Rows without a date extend the narration before them
    where they hold no money. Rows that carry totals, and rows whose date or amount cannot be read, are left out. card:
    amounts without a mark are debits, and there are no balances. Of one amount column without marks the change of the
    balance tells the direction.
    """
    order = Window.partitionBy("doc_id").orderBy("page_number", "table_no", "row_no")
    within = Window.partitionBy("doc_id", "page_number", "table_no").orderBy("row_no")
    rows = tables.withColumn("place", F.row_number().over(within))
    rows = rows.withColumn("roles", F.when(F.col("place") <= HEADER_ROWS, header_roles("cells")))
    head = (F.col("place") <= HEADER_ROWS) & usable(F.col("roles"))
    rows = rows.withColumn("head_at", F.min(F.when(head, F.col("place"))).over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    is_head = F.coalesce(F.col("place") == F.col("head_at"), F.lit(False))
    rows = rows.withColumn("map", F.last(F.when(is_head, F.col("roles")), ignorenulls=True).over(order))
    rows = rows.where("map is not null and (head_at is null or place > head_at)")

    def cell(role: str) -> Column:
        at = F.array_position("map", role)
        return F.when(at > 0, collapse(F.coalesce(F.get("cells", (at - 1).cast("int")), F.lit("")))).otherwise("")

    names = ("date", "value_date", "description", "debit", "credit", "amount", "balance", "reference")
    rows = rows.withColumns({f"c_{n}": cell(n) for n in names})
    rows = rows.where(~F.col("c_description").rlike(NO_TRANSACTION) & F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    money = (F.col("c_debit") != "") | (F.col("c_credit") != "") | (F.col("c_amount") != "")
    starts, goes_on = F.col("c_date") != "", (F.col("c_date") == "") & ~money & (F.col("c_description") != "")
    nonzero = lambda c: F.nullif(F.abs(parse_amount(c)), F.lit(0))
    two = (F.col("c_debit") != "") | (F.col("c_credit") != "")
    marked = amount_direction("c_amount")
    rows = rows.withColumns(
        {
            "day": parse_date("c_date", year_hint), "two": two, "debit": nonzero("c_debit"), "credit": nonzero("c_credit"), "single": F.abs(parse_amount("c_amount")),
            "marked": F.coalesce(marked, F.lit("debit")) if card else marked, "balance": F.lit(None).cast("decimal(18,2)") if card else parse_amount("c_balance"),
        }
    )
    read = starts & F.col("day").isNotNull() & F.when(two, F.coalesce("debit", "credit").isNotNull()).otherwise(F.col("single").isNotNull())
    rows = rows.withColumn("read", F.coalesce(read, F.lit(False))).withColumn("row", F.sum(F.when(F.col("read"), 1).otherwise(0)).over(order))
    rows = rows.where((F.col("read") | goes_on) & (F.col("row") > 0))
    at = F.struct("page_number", "table_no", "row_no")
    texts = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("c_description").alias("text"))))
    kept = ("page_number", "row_no", "day", "c_value_date", "two", "debit", "credit", "single", "marked", "balance", "c_reference")
    one = rows.groupBy("doc_id", "row").agg(
        F.max(F.when(F.col("read"), F.struct(*kept))).alias("first"), F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("description")
    ).select("doc_id", "row", "description", "first.*")
    change = F.col("balance") - F.lag("balance").over(Window.partitionBy("doc_id").orderBy("row"))
    by_balance = F.when(change < 0, "debit").when(change > 0, "credit")
    way = F.when(F.col("two"), F.when(F.col("debit").isNotNull(), "debit").otherwise("credit")).otherwise(F.coalesce("marked", by_balance))
    amount = F.when(F.col("two"), F.coalesce("debit", "credit")).otherwise(F.col("single"))
    return one.withColumn("direction", way).where("direction is not null").select(
        "doc_id", F.col("page_number").alias("source_page"), F.col("row_no").alias("source_row"), F.col("day").alias("txn_date"), parse_date("c_value_date", year_hint).alias("value_date"),
        F.trim("description").alias("description"), amount.alias("amount"), "direction", F.col("balance").alias("balance_after"), F.nullif(F.col("c_reference"), F.lit("")).alias("reference"),
    )


def narration_check(rows: DataFrame) -> DataFrame:
    """Adds direction_confidence and conflict: where the narration's opening says the other way, the row is doubted, not changed."""
    said = F.when(F.col("description").rlike(GOES_OUT), "debit").when(F.col("description").rlike(COMES_IN), "credit")
    conflict = F.coalesce(said != F.col("direction"), F.lit(False))
    return rows.withColumns({"conflict": conflict, "direction_confidence": F.when(conflict, 0.55).otherwise(1.0)})
