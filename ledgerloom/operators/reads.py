"""Reads over stored frames: points, trails, notices, budgets against spend, derived states and sentences."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MERCHANT_RAILS

from ..functions.money import grouped, rupees

# Kinds of accounts that are known, and the namespace of URLs for name-based identifiers.
ACCOUNT_TYPES = ("savings", "current", "credit_card", "salary", "overdraft")
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def live(frame: DataFrame) -> DataFrame:
    """Rows that are not deleted."""
    return frame.where("deleted_at is null")


def point(frame: DataFrame, **keys) -> DataFrame:
    """The rows with these values, a tenant's key among them."""
    for column, value in keys.items():
        frame = frame.where(F.col(column) == value)
    return frame


def audit_trail(events: DataFrame, users: DataFrame) -> DataFrame:
    """Audit events with the names of who acted, the newest first; events of nobody known stay."""
    named = events.join(users.select(F.col("user_id").alias("actor_id"), F.col("name").alias("actor")), "actor_id", "left")
    return named.orderBy(F.desc("at"), F.desc("event_id"))


def notices(rows: DataFrame, user: int, unread_only: bool = False, most: int = 50) -> DataFrame:
    """A user's notices and those to everybody, the newest first."""
    own = rows.where((F.col("user_id") == user) | F.col("user_id").isNull())
    own = own.where(~F.col("is_read")) if unread_only else own
    return own.orderBy(F.desc("at"), F.desc("notice_id")).limit(most)


def marked_read(rows: DataFrame, user: int, notice_id: int | None = None) -> DataFrame:
    """The notices with one of the user's, or all of them, read."""
    own = (F.col("user_id") == user) | F.col("user_id").isNull()
    return rows.withColumn("is_read", F.col("is_read") | F.coalesce(own if notice_id is None else own & (F.col("notice_id") == notice_id), F.lit(False)))


def newest(rows: DataFrame, most: int, at: str, key: str) -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(key)).limit(most)


def spend_against(calls: DataFrame, month: date, ceiling: str) -> DataFrame:
    """One row: the month's cost of calls (at, cost), and whether it has reached the ceiling."""
    here = calls.where(F.trunc("at", "MM") == F.lit(month.replace(day=1)))
    spent = F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(18,6)")
    return here.agg(spent.alias("spent"), (spent >= F.lit(ceiling).cast("decimal(18,6)")).alias("over_ceiling"))


def statement_states(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Statements with what persisting their rows leaves: how many rows were extracted, and the state that follows."""
    counts = rows.groupBy("statement_id").agg(F.count("*").alias("extracted_count"), F.count_if(F.col("review_status") == "review_required").alias("to_review"))
    both = statements.join(counts, "statement_id", "left").na.fill(0, ["extracted_count", "to_review"])
    state = F.when(F.col("extracted_count") == 0, "failed").when(F.col("to_review") > 0, "needs_review").otherwise("processed")
    return both.withColumn("state", state)


def statement_list(statements: DataFrame, accounts: DataFrame, extracted: DataFrame, jobs: DataFrame) -> DataFrame:
    """Live statements, each with its account's bank and type, how many rows were extracted (0 if unknown) and its newest job.

    accounts: account_id (each once), bank_name, account_type; extracted: statement_id (each once), extracted_count, which is
    what was read and not what reached the ledger; jobs: job_id, statement_id, created_at, state, progress. Of jobs of one
    time the greatest job_id counts; a statement without a job stays, with nulls.
    """
    newest_job = F.max(F.struct("created_at", "job_id", "state", "progress")).alias("j")
    last = jobs.where("statement_id is not null").groupBy("statement_id").agg(newest_job)
    rows = live(statements).join(accounts.select("account_id", "bank_name", "account_type"), "account_id", "left")
    rows = rows.join(extracted.select("statement_id", "extracted_count"), "statement_id", "left").join(last, "statement_id", "left")
    job = {"job_id": F.col("j.job_id"), "job_state": F.col("j.state"), "progress": F.col("j.progress")}
    return rows.withColumns({"extracted_count": F.coalesce("extracted_count", F.lit(0)), **job}).drop("j")


def account_type(document_type: Column, known: Column) -> Column:
    """A card document wins, else the known type, else savings."""
    return F.when(document_type == "credit_card_statement", "credit_card").when(known.isin(*ACCOUNT_TYPES), known).otherwise("savings")


def with_category_ids(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """rows with the id of their category's slug; an unknown slug has none."""
    return rows.join(categories.select(F.col("slug").alias("category"), "category_id"), "category", "left")


def set_difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def set_union(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    return left.select(*keys).unionByName(right.select(*keys)).distinct()


def saved_budgets(budgets: DataFrame, changed: DataFrame) -> DataFrame:
    """Budgets (tenant_id, category, amount, alert_threshold, is_active) with those of the same tenant and category replaced."""
    return budgets.join(changed.select("tenant_id", "category"), ["tenant_id", "category"], "left_anti").unionByName(changed)


def without_budget(budgets: DataFrame, tenant_id: int, category: str) -> DataFrame:
    """The budgets with one switched off."""
    hit = (F.col("tenant_id") == tenant_id) & (F.col("category") == category)
    return budgets.withColumn("is_active", F.col("is_active") & ~hit)


def plural(n: Column, one: str, many: str | None = None) -> Column:
    """The number and its noun: 1 row, 2 rows."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def url_key(name: Column) -> Column:
    """The name-based identifier (version 5) of a URL-like name."""
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def monthly_key(kind: str, id_: Column, month: Column) -> Column:
    """One identifier for a thing and a month."""
    return url_key(F.concat(F.lit(f"{kind}/"), id_.cast("string"), F.lit("/"), F.date_format(F.trunc(month, "MM"), "yyyy-MM-dd")))


def display_name(bank: Column, account: Column) -> Column:
    """A bank's name and an account's last four digits behind dots."""
    last = F.right(F.regexp_replace(account, r"\D", ""), F.lit(4))
    return F.concat(bank, F.lit(" ••••"), F.coalesce(last, F.lit("")))


def explanation(source: Column, merchant: Column, category: Column, detail: Column, score: Column) -> Column:
    """Why a row has its category, by what decided it. detail: the alias, the matched text, the samples or the model; score: the model's."""
    who, what = F.coalesce(merchant, F.lit("this transaction")), F.coalesce(category, F.lit("Other"))
    quoted = lambda before: F.when(F.coalesce(detail, F.lit("")) != "", F.concat(F.lit(before), detail, F.lit('"'))).otherwise("")
    # The sentences that are shown.
    sentences = {
        "user_rule": F.concat(F.lit("You set this. "), who, F.lit(" → "), what, F.lit(".")),
        "verified_merchant_rule": F.concat(F.lit("Recognised "), who, F.lit(" in the merchant dictionary"), quoted(' — the statement said "'), F.lit(", which is categorised as "), what, F.lit(".")),
        "deterministic_rule": F.concat(F.lit("A rule matched"), quoted(' on "'), F.lit(", which identifies this as "), what, F.lit(". No AI was involved.")),
        "historical_pattern": F.concat(F.lit("You have categorised "), who, F.lit(" as "), what, F.lit(" "), F.coalesce(detail, F.lit("None")), F.lit(" times before.")),
        "ai_model": F.concat(
            F.lit("No rule matched, so "), F.coalesce(detail, F.lit("the model")), F.lit(" suggested "), what,
            F.when(score.isNotNull(), F.concat(F.lit(" (confidence "), score.cast("string"), F.lit(")"))).otherwise(""),
            F.lit(". It saw only the merchant name and an amount range."),
        ),
    }
    found = F.lit("Nothing recognised this transaction, so it is uncategorised. Setting a category here teaches the system for next time.")
    for name, sentence in sentences.items():
        found = F.when(source == name, sentence).otherwise(found)
    return found


def findings(anomalies: DataFrame, budgets: DataFrame, month: date, most: int = 5) -> DataFrame:
    """A month's notices: each tenant's largest anomalies, and its exceeded budgets of that month (category, spent, amount, state)."""
    first = F.lit(month.replace(day=1))
    largest = Window.partitionBy("tenant_id").orderBy(F.desc_nulls_last("observed"), "kind", "ref")
    odd = anomalies.where(F.col("month") == first).withColumn("ref", F.coalesce("txn_id", "category")).withColumn("n", F.row_number().over(largest)).where(F.col("n") <= most)
    odd = odd.select("tenant_id", F.lit("anomaly_detected").alias("kind"), F.lit("Something stands out").alias("title"), F.col("reason").alias("body"), F.col("ref").alias("resource"))
    over = budgets.where("state = 'exceeded'")
    # The sentences that are shown.
    body = F.concat(F.lit("₹"), F.col("spent").cast("string"), F.lit(" spent against a ₹"), F.col("amount").cast("string"), F.lit(" budget this month."))
    key = monthly_key("budget", F.concat_ws(":", "tenant_id", "category"), first)
    over = over.select("tenant_id", F.lit("budget_breach").alias("kind"), F.concat("category", F.lit(" is over budget")).alias("title"), body.alias("body"), key.alias("resource"))
    return odd.unionByName(over)


def narrative_view(report: DataFrame, merchants: DataFrame, most: int = 5) -> DataFrame:
    """What a model may see of a monthly report: whole rupees and percents, and only merchants that may leave.

    report: rows of the monthly summary; merchants: tenant_id, month, place, merchant, total, transaction_count, sendable.
    """
    shown = F.struct(
        "place", F.when(F.col("sendable"), F.col("merchant")).alias("merchant"), (F.col("merchant").isNotNull() & ~F.col("sendable")).alias("merchant_withheld"),
        rupees("total").alias("total_rupees"), "transaction_count",
    )
    top = merchants.where(F.col("place") <= most).groupBy("tenant_id", "month").agg(F.array_sort(F.collect_list(shown)).alias("top_merchants"))
    figures = {f"{n}_rupees": rupees(c) for n, c in (("spending", "expenses"), ("income", "income"), ("net_cash_flow", "net_cash_flow"))}
    return report.join(top, ["tenant_id", "month"], "left").select(
        "tenant_id", F.date_format("month", "MMMM yyyy").alias("month_label"), *(v.alias(k) for k, v in figures.items()),
        F.round(F.col("savings_rate") * 100, 0).cast("int").alias("savings_rate_percent"), "transaction_count", "top_merchants",
        (~F.col("fully_trusted")).alias("figures_include_unverified"), F.col("awaiting_review").alias("awaiting_review_count"),
    )


def import_sentence(rows: Column, to_review: Column, total: Column) -> Column:
    """What an import brought, in a sentence."""
    return F.concat(plural(rows, "transaction"), F.lit(" worth "), grouped(total), F.lit(", "), plural(to_review, "row"), F.lit(" to review."))


def business_merchants(payments: DataFrame, known: DataFrame) -> DataFrame:
    """tenant_id, merchant and by (dictionary or rail) of the names that are businesses.

    payments: tenant_id, merchant, rail. known: name, in any case. A name that the dictionary lacks is one if every payment to
    it went over a rail that no person is on; rails that are not known (null) say nothing.
    """
    rails = payments.where("merchant is not null and merchant <> ''").groupBy("tenant_id", "merchant")
    rails = rails.agg(F.coalesce(F.bool_and(F.col("rail").isin(*MERCHANT_RAILS)), F.lit(False)).alias("by_rail")).withColumn("name", F.lower("merchant"))
    found = rails.join(known.select(F.lower("name").alias("name"), F.lit(True).alias("known")).distinct(), "name", "left")
    return found.where("known or by_rail").select("tenant_id", "merchant", F.when(F.col("known"), "dictionary").otherwise("rail").alias("by"))
