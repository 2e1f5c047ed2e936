"""The trust layer: totals, running balances, pages, fingerprints, confidence and statement health."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import signed

# Confidence of each source of a category, penalties and caps, and review bands.
SOURCE_CONFIDENCE = {
    "user_rule": "1.00",
    "verified_merchant_rule": "0.98",
    "deterministic_rule": "0.97",
    "historical_pattern": "0.90",
    "ai_model": "0.85",
    "fallback_other": "0.60",
}
OCR_FACTOR, DUPLICATE_CAP, PERIOD_CAP, PAGES_CAP = "0.92", "0.60", "0.85", "0.70"
AUTO_APPROVE_AT, FLAG_AT = "0.97", "0.90"
PERIOD_SLACK_DAYS = 3


def _score(x: str) -> Column:
    return F.lit(x).cast("decimal(6,4)")


def reconcile(statements: DataFrame, lines: DataFrame) -> DataFrame:
    """Per statement: totals, delta, trust status, balance walk, missing pages and rows outside the period.

    Banks: opening - debits + credits = closing; cards: opening + debits - credits = due. Without both printed balances
    a statement is pending; it is trusted at a delta of 0.00 only. The walk compares each printed balance with the one
    printed before it (the opening balance at first) and the row's own amount; rows without one are passed over, not
    added up. Pages between the first and the last with rows should have rows.
    """
    order = Window.partitionBy("statement_id").orderBy("source_row")
    opening = statements.select("statement_id", "opening_balance", "closing_balance", "document_type", "period_start", "period_end")
    rows = lines.select("statement_id", "source_row", "source_page", "txn_date", "amount", "direction", "balance_after").join(opening, "statement_id")
    last = F.last("balance_after", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    expected = F.coalesce(last, "opening_balance") + signed()
    out = (F.col("txn_date") < F.date_sub("period_start", PERIOD_SLACK_DAYS)) | (F.col("txn_date") > F.date_add("period_end", PERIOD_SLACK_DAYS))
    rows = rows.withColumns({"breaks": F.col("balance_after").isNotNull() & (F.col("balance_after") != expected), "out": out})
    sums = rows.groupBy("statement_id").agg(
        F.coalesce(F.sum(F.when(F.col("direction") == "debit", F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias("total_debits"),
        F.coalesce(F.sum(F.when(F.col("direction") == "credit", F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias("total_credits"),
        F.count("balance_after").alias("printed"),
        F.min(F.when(F.col("breaks"), F.col("source_row"))).alias("first_divergent_row"),
        F.array_sort(F.collect_set("source_page")).alias("pages"),
        F.count_if("out").alias("out_of_period"),
    )
    whole = statements.select("tenant_id", "account_id", *opening.columns).join(sums, "statement_id", "left")
    debits, credits = (F.coalesce(c, F.lit(0)) for c in ("total_debits", "total_credits"))
    moved = F.when(F.col("document_type") == "credit_card_statement", debits - credits).otherwise(credits - debits)
    delta = (F.col("opening_balance") + moved - F.col("closing_balance")).cast("decimal(18,2)")
    span = F.sequence(F.element_at("pages", 1), F.element_at("pages", -1))
    missing = F.coalesce(F.when(F.size("pages") > 0, F.array_except(span, F.col("pages"))), F.array().cast("array<int>"))
    checked = F.col("opening_balance").isNotNull() & (F.col("printed") >= 2)
    return whole.select(
        "tenant_id", "account_id", "statement_id", "document_type",
        debits.cast("decimal(18,2)").alias("total_debits"), credits.cast("decimal(18,2)").alias("total_credits"), delta.alias("delta"),
        F.when(delta.isNull(), "pending").when(delta == 0, "trusted").otherwise("untrusted").alias("trust_status"),
        F.coalesce(checked, F.lit(False)).alias("balance_checked"),
        (F.coalesce(checked, F.lit(False)) & F.col("first_divergent_row").isNull()).alias("balance_continuous"),
        F.when(checked, F.col("first_divergent_row")).alias("first_divergent_row"),
        missing.alias("missing_pages"), (F.size(missing) == 0).alias("pages_continuous"), F.coalesce("out_of_period", F.lit(0)).alias("out_of_period"),
    )


def balance_movement(lines: DataFrame) -> DataFrame:
    """Lines with the confidence of amount and direction (0.90), and a warning and 0.50 for both where the balance moved by another amount.

    A printed balance is held against the one printed before it in the statement; without either there is nothing to check.
    """
    before = Window.partitionBy("statement_id").orderBy("source_row").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.abs(F.col("balance_after") - F.last("balance_after", ignorenulls=True).over(before))
    wrong = F.coalesce(moved != F.col("amount"), F.lit(False))
    sure = F.when(F.col("_wrong"), F.lit("0.50")).otherwise(F.lit("0.90")).cast("decimal(3,2)")
    warning = F.when(F.col("_wrong"), "balance_movement_mismatch")
    return lines.withColumn("_wrong", wrong).withColumns({"amount_confidence": sure, "direction_confidence": sure, "warning": warning}).drop("_wrong")


def validation_score() -> Column:
    """One score for all rows of a statement, over reconcile()'s columns."""
    exact = F.when(F.col("balance_checked") & F.col("balance_continuous"), _score("0.99")).when(F.col("balance_checked"), _score("0.70")).otherwise(_score("0.97"))
    score = F.when(F.col("delta").isNull(), _score("0.80")).when(F.col("delta") != 0, _score("0.55")).otherwise(exact)
    return F.when(F.col("pages_continuous"), score).otherwise(F.least(score, _score(PAGES_CAP))).cast("decimal(6,4)")


def health(report: DataFrame) -> DataFrame:
    """Named checks of a statement as pass, warn or fail."""
    check = lambda ok, bad: F.when(ok, "pass").otherwise(bad)
    return report.select(
        "statement_id",
        F.struct(
            F.when(F.col("delta").isNull(), "warn").otherwise(check(F.col("delta") == 0, "fail")).alias("reconciliation"),
            F.when(~F.col("balance_checked"), "warn").otherwise(check(F.col("balance_continuous"), "fail")).alias("running_balance"),
            check(F.col("pages_continuous"), "warn").alias("pages"),
            check(F.col("out_of_period") == 0, "warn").alias("period"),
        ).alias("checks"),
        validation_score().alias("validation"),
    )


def identity_text(slug: Column, description: Column) -> Column:
    """What names a transaction across printings: the merchant's slug, else its narration without machine noise."""
    from ..functions.narration import strip_machine_noise

    bare = F.trim(F.regexp_replace(F.regexp_replace(F.upper(strip_machine_noise(description)), "[^A-Z0-9 ]+", " "), r"\s+", " "))
    return F.coalesce(F.upper(slug), F.when(bare != "", bare), F.lit("UNKNOWN"))


def fingerprinted(rows: DataFrame, text: Column, order: str = "source_row") -> DataFrame:
    """Adds occurrence (0 for the first of equal rows of a statement) and the fingerprint over seven parts; never the balance."""
    rows = rows.withColumn("identity", text)
    same = Window.partitionBy("statement_id", "txn_date", "amount", "direction", "identity").orderBy(order)
    rows = rows.withColumn("occurrence", F.row_number().over(same) - 1)
    parts = F.concat_ws(
        "|", F.col("tenant_id").cast("string"), F.col("account_id").cast("string"), F.date_format("txn_date", "yyyy-MM-dd"),
        F.col("amount").cast("decimal(18,2)").cast("string"), "direction", "identity", F.col("occurrence").cast("string"),
    )
    return rows.withColumn("fingerprint", F.sha2(parts, 256))


def keyed_hash(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 (RFC 2104) of a string's UTF-8 bytes, in lowercase hex; null for null.

    The padded key becomes a literal, so whoever may read the plan's literals may forge it.
    """
    whole = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in whole)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def account_fingerprint(tenant: Column, bank: Column, kind: Column, last4: Column, key: bytes) -> Column:
    """What names an account within a deployment, of parts that are no secrets; null if one of them is."""
    parts = [F.lit(":") if i % 2 else (tenant, bank, kind, last4)[i // 2].cast("string") for i in range(7)]
    return keyed_hash(F.concat(*parts), key)


def new_rows(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of the batch whose fingerprint neither the ledger nor an earlier row of the batch has."""
    first = Window.partitionBy("tenant_id", "account_id", "fingerprint").orderBy("statement_id", "source_row")
    fresh = batch.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return fresh.join(ledger.select("tenant_id", "account_id", "fingerprint"), ["tenant_id", "account_id", "fingerprint"], "left_anti")


def confidence(rows: DataFrame) -> DataFrame:
    """Adds four scores, their least, the weakest one's name and the review status.

    Columns taken: field_confidence (map), merchant_confidence, category_source, category_slug, validation, from_ocr,
    suspected_duplicate, strictly_out_of_period. The band is taken before the least is rounded for storage.
    """
    fields = [F.coalesce(F.element_at("field_confidence", k), F.lit(1.0)) for k in ("date", "amount", "direction")]
    extraction = F.least(*fields).cast("decimal(12,6)") * F.when(F.col("from_ocr"), _score(OCR_FACTOR)).otherwise(_score("1"))
    merchant = F.coalesce("merchant_confidence", F.lit(0.5)).cast("decimal(12,6)")
    tier = F.lit("0.60")
    for name, value in SOURCE_CONFIDENCE.items():
        tier = F.when(F.col("category_source") == name, value).otherwise(tier)
    tier = tier.cast("decimal(12,6)")
    category = F.when(F.col("category_source") == "verified_merchant_rule", F.least(tier, merchant)).otherwise(tier)
    category = F.when(F.col("category_slug").isNull(), F.least(category, _score("0.60"))).otherwise(category)
    valid = F.col("validation").cast("decimal(12,6)")
    valid = F.when(F.col("suspected_duplicate"), F.least(valid, _score(DUPLICATE_CAP))).otherwise(valid)
    valid = F.when(F.col("strictly_out_of_period"), F.least(valid, _score(PERIOD_CAP))).otherwise(valid)
    clamp = lambda c: F.bround(F.greatest(F.lit(0), F.least(F.lit(1), c)), 4).cast("decimal(6,4)")
    names = {"extraction": extraction, "merchant": merchant, "category": category, "validation": valid}
    rows = rows.withColumns({f"confidence_{k}": clamp(c) for k, c in names.items()})
    ranked = F.array_min(F.array(*(F.struct(F.col(f"confidence_{k}").alias("score"), F.lit(i).alias("at"), F.lit(k).alias("name")) for i, k in enumerate(names))))
    rows = rows.withColumn("_least", ranked)
    least = F.col("_least.score")
    status = F.when(least >= _score(AUTO_APPROVE_AT), "auto_approved").when(least >= _score(FLAG_AT), "flagged").otherwise("review_required")
    return rows.withColumns({"review_status": status, "weakest": F.col("_least.name"), "confidence_min": F.bround(least, 3).cast("decimal(4,3)")}).drop("_least")
