"""Canonical statements as JSON, document classification, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EXPORT_CAP

# Money and dates are strings in the files, so that no reader makes floats of them.
TRANSACTION = (
    "txn_date string, value_date string, description string, amount string, direction string, balance_after string, reference string, "
    "merchant_normalized string, merchant_slug string, payment_method string, category_slug string, subcategory_slug string"
)
STATEMENT = (
    "fixture string, generator_version string, seed int, page_count int, metadata struct<bank_code:string,bank_name:string,document_type:string,"
    "account_last4:string,period_start:string,period_end:string,opening_balance:string,closing_balance:string,declared_transaction_count:int,"
    "total_amount_due:string,minimum_amount_due:string,payment_due_date:string,credit_limit:string>, transactions array<struct<"
    + ",".join(":".join(f.split()) for f in TRANSACTION.split(", "))
    + ">>"
)
# Phrases that mark the kinds of documents.
MARKERS = {
    "bank_statement": ("account statement", "statement of account", "savings account", "current account", "closing balance", "withdrawal"),
    "credit_card_statement": ("credit card", "total amount due", "minimum amount due", "payment due date", "credit limit"),
}


def _typed(rows: DataFrame) -> DataFrame:
    meta = {c: F.col(f"metadata.{c}") for c in ("bank_code", "document_type", "account_last4")}
    meta |= {c: F.col(f"metadata.{c}").cast("date") for c in ("period_start", "period_end")}
    meta |= {c: F.col(f"metadata.{c}").cast("decimal(18,2)") for c in ("opening_balance", "closing_balance", "total_amount_due")}
    return rows.select("fixture", "page_count", *(c.alias(n) for n, c in meta.items()), "transactions")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """One row per statement file, money as decimals and dates as dates."""
    return _typed(spark.read.schema(STATEMENT).option("multiLine", True).json(path))


def parsed_statements(rows: DataFrame, column: str = "json") -> DataFrame:
    """As read_statements(), of statements held as JSON text."""
    return _typed(rows.select(F.from_json(column, STATEMENT).alias("s")).select("s.*"))


def statement_rows(statements: DataFrame) -> DataFrame:
    """One row per transaction, with its place in the statement."""
    rows = statements.select("fixture", F.posexplode("transactions").alias("source_row", "t")).select("fixture", "source_row", "t.*")
    for c, kind in (("txn_date", "date"), ("value_date", "date"), ("amount", "decimal(18,2)"), ("balance_after", "decimal(18,2)")):
        rows = rows.withColumn(c, F.col(c).cast(kind))
    return rows


def classify_document(text: Column) -> tuple[Column, Column]:
    """Kind and confidence by the marker phrases that a text has: the majority, unknown on a tie (0.5) or without any (0)."""
    lower = F.lower(text)
    bank, card = (sum((F.contains(lower, F.lit(m)).cast("int") for m in MARKERS[k]), F.lit(0)) for k in ("bank_statement", "credit_card_statement"))
    total = bank + card
    kind = F.when(bank > card, "bank_statement").when(card > bank, "credit_card_statement").otherwise("unknown")
    score = F.when(total == 0, F.lit(0.0)).when(bank == card, F.lit(0.5)).otherwise(F.round(F.greatest(bank, card) / total, 3))
    return kind, score


def gather_export(rows: DataFrame, cap: int | None = EXPORT_CAP) -> DataFrame:
    """The rows in ascending order; more than the cap, where there is one, raise an error, none are cut off."""
    if cap is not None and rows.limit(cap + 1).count() > cap:
        raise ValueError(f"an export holds {cap} rows at most; narrow the filter")
    return rows.orderBy("txn_date", "txn_id")


def csv_columns(rows: DataFrame) -> DataFrame:
    """Exact decimals, and yes or no for booleans, as text."""
    return rows.select([F.when(F.col(c), "yes").otherwise("no").alias(c) if t == "boolean" else F.col(c).cast("string").alias(c) for c, t in rows.dtypes])


def json_columns(rows: DataFrame) -> DataFrame:
    """Money as strings."""
    return rows.select([F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in rows.dtypes])


def export_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with CRLF line ends."""
    csv_columns(gather_export(rows)).coalesce(1).write.option("header", True).option("lineSep", "\r\n").mode("overwrite").csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON-lines file."""
    json_columns(gather_export(rows)).coalesce(1).write.mode("overwrite").json(path)


def new_uploads(uploads: DataFrame, content: str, key: str, live: DataFrame | None = None) -> DataFrame:
    """hash and key of the first upload of each content, by hash, but for contents that live statements (hash) have."""
    first = uploads.groupBy(F.sha2(content, 256).alias("hash")).agg(F.min(key).alias(key))
    return first if live is None else first.join(live.select("hash"), "hash", "left_anti")

