"""The perimeter around models: what may be sent, checks of finished views, and checks of what comes back.

No model is called here. Every check fails closed: what cannot be shown to be safe is blocked, with the reason.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .money import bucket
from .narration import _let
from .safety import injection_reason, merchant_sendable, spans_of

# The categories and rails that exist, weekdays, and the limits of what is sent and taken back.
CATEGORIES = (
    "food", "grocery", "rent", "utilities", "shopping", "travel", "fuel", "entertainment", "subscriptions", "healthcare", "insurance",
    "education", "emi", "investment", "salary", "bank_charges", "taxes", "cash_withdrawal", "transfers", "credit_card_payment", "refund", "other",
)
RAILS = ("upi", "card", "atm", "neft", "imps", "rtgs", "cheque", "nach", "ach", "netbanking", "cash", "unknown")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
MERCHANT_LENGTH, REASONING_LENGTH, PROSE_LENGTH = 80, 200, 1200
# Patterns of output that no answer may hold.
TOOL_SHAPE = r'"?(?:function_call|tool_call|tool_use|function|arguments|parameters)"?\s*[:=]|<function|<tool|\{\s*"name"\s*:'
URL = r"https?://|www\.|\b\w+\.(?:com|net|org|io|ai|co|in)\b"
MARKUP = r"```|<script|javascript:|data:text/html|<\|"
CURRENCY_SPAN = r"(?:₹|\bRs\.?|\bINR)\s*\d[\d,]*(?:\.\d+)?"
WITHHELD = "[withheld]"


@F.pandas_udf(T.StringType())
def first_kind(texts: pd.Series) -> pd.Series:
    """The kind of the first sensitive span of each text, or null."""
    return texts.map(lambda t: _kind_of(t) if t else None)


@lru_cache(maxsize=20_000)
def _short_kind(text: str) -> str | None:
    return next((k for k, _, _ in spans_of(text)), None)


def _kind_of(text: str) -> str | None:
    """Answers of models are short and come again; long texts are not kept."""
    return _short_kind(text) if len(text) <= 400 else _short_kind.__wrapped__(text)


def payload(merchant: Column, known: Column, description: Column, amount: Column, direction: Column, rail: Column, mcc: Column, day: Column) -> Column:
    """The six fields that may be sent, as a struct, without regard to what stands in them."""
    sendable = merchant_sendable(merchant, known, rail, description)
    weekday = F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day))
    return F.struct(
        F.when(sendable, merchant).alias("merchant"), bucket(amount).alias("amount_bucket"), direction.alias("direction"),
        rail.alias("payment_method"), mcc.alias("mcc_hint"), weekday.alias("day_of_week"),
    )


def checked_payload(built: Column) -> tuple[Column, Column, Column]:
    """A payload that may be sent or null, what blocked it, and the field that did.

    Fields outside the allow-list block first, then a missing merchant, then the first field in which a scan of the finished
    values finds something.
    """
    held = {f: built[f] for f in ("merchant", "amount_bucket", "direction", "payment_method", "mcc_hint", "day_of_week")}
    wrong = (
        ~F.coalesce(held["direction"].isin("debit", "credit"), F.lit(False)) | ~F.coalesce(held["payment_method"].isin(*RAILS), F.lit(False))
        | held["amount_bucket"].isNull() | (F.char_length(held["merchant"]) > MERCHANT_LENGTH) | ~held["mcc_hint"].rlike(r"^\d{4}$")
    )
    found = {f: first_kind(c) for f, c in held.items() if f in ("merchant", "mcc_hint")}  # the other fields are of closed sets
    kind = F.coalesce(*found.values())
    field = F.coalesce(*(F.when(k.isNotNull(), f) for f, k in found.items()))
    by = F.when(F.coalesce(wrong, F.lit(False)), "schema_violation").when(held["merchant"].isNull(), "no_sendable_merchant").otherwise(kind)
    return F.when(by.isNull(), built), by, F.when(by == kind, field)


def merchant_for_model(name: Column, known: Column, rail: Column) -> Column:
    """The name as a model may see it, or null: never one that reads like an instruction."""
    safe = (F.coalesce(name, F.lit("")) != "") & injection_reason(name).isNull()
    return F.when(safe & (F.coalesce(known, F.lit(False)) | F.coalesce(F.lower(rail).isin("card", "nach", "ach"), F.lit(False))), name)


def scrub_mentions(sentence: Column, withheld: Column) -> Column:
    """The sentence with each withheld name replaced."""
    names = F.filter(withheld, lambda n: F.coalesce(n, F.lit("")) != "")
    return F.aggregate(names, sentence, lambda s, n: F.replace(s, n, F.lit(WITHHELD)))


def blocked_view(strings: Column) -> Column:
    """Why a view, given as all its strings, must not be sent: the first finding of a scan, or text that reads like an instruction; else null."""
    kept = F.filter(strings, lambda s: s.isNotNull())
    joined = first_kind(F.array_join(kept, "\n"))
    return F.coalesce(joined, F.when(F.exists(kept, lambda s: injection_reason(s).isNotNull()), "injection_in_tool_result"))


def _bad_shape(text: Column) -> Column:
    hits = (("tool_call_shape", TOOL_SHAPE), ("url_in_output", URL), ("markup_in_output", MARKUP))
    found = F.lit(None).cast("string")
    for name, pattern in reversed(hits):
        found = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(found)
    return found


def prediction(answer: Column) -> Column:
    """A model's JSON answer as rejected_by, detector, category, confidence and reasoning; rejected_by is null where it holds.

    Sensitive data is looked for before anything else, then shapes of calls, links and markup, then the closed set of categories,
    a confidence from 0 to 1 and a reasoning that is text.
    """
    field = lambda name: F.get_json_object(answer, f"$.{name}")
    typed = lambda v, name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    parsed = lambda v: F.struct(F.variant_get(v, "$", "string").alias("raw"), typed(v, "category").alias("category"), typed(v, "reasoning").alias("reasoning"))
    read = F.struct(
        first_kind(answer).alias("kind"), F.trim(answer).startswith("{").alias("opens"), _let(F.try_parse_json(answer), parsed).alias("types"),
        F.translate(F.lower(F.trim(field("category"))), " -", "__").alias("slug"), F.coalesce(field("confidence"), F.lit("0")).try_cast("decimal(20,10)").alias("number"),
        field("reasoning").alias("reasoning"),
    )

    def judged(r: Column) -> Column:
        raw, number, types = r["types"]["raw"], r["number"], r["types"]
        return (
            F.when(raw.isNull() | ~r["opens"], "not_an_object").when(r["kind"].isNotNull(), "pii_echo")
            .otherwise(F.coalesce(_bad_shape(raw), F.when(F.coalesce(types["category"] != "STRING", F.lit(True)), "missing_category")
            .when(~r["slug"].isin(*CATEGORIES), "unknown_category").when(number.isNull(), "unparseable_confidence")
            .when((number < 0) | (number > 1), "confidence_out_of_range").when(~F.coalesce(types["reasoning"].isin("STRING", "VOID"), F.lit(True)), "malformed_reasoning")))
        )

    def shown(h: Column) -> Column:
        r, by, ok = h["r"], h["by"], h["by"].isNull()
        return F.struct(
            by.alias("rejected_by"), F.when(by == "pii_echo", r["kind"]).alias("detector"), F.when(ok, r["slug"]).alias("category"),
            F.when(ok, F.bround(r["number"], 4).cast("decimal(5,4)")).alias("confidence"),
            F.when(ok, F.nullif(F.substring(F.trim(r["reasoning"]), 1, REASONING_LENGTH), F.lit(""))).alias("reasoning"),
        )

    # Each step is computed once a row, however many of the struct's fields are read.
    return _let(read, lambda r: _let(F.struct(r.alias("r"), judged(r).alias("by")), shown))


def rejected_prose(text: Column) -> tuple[Column, Column]:
    """Why a generated sentence must not be shown, or null, and the kind of sensitive data found; amounts of money are none."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    kind = first_kind(F.regexp_replace(bare, f"(?i){CURRENCY_SPAN}", " "))
    by = (
        F.when(text.isNull(), "not_text").when(bare == "", "empty").when(F.char_length(bare) > PROSE_LENGTH, "oversized")
        .when(kind.isNotNull(), "pii_echo").otherwise(_bad_shape(bare))
    )
    return by, F.when(by == "pii_echo", kind)
