"""Sensitive data in text: detectors, redaction, injection guard, and validators of generated text.

Flags are expressions. Spans need the order and overlap rules of the detectors, so they come from a pandas function
over Arrow batches; it runs only on rows that the flags let through.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MERCHANT_RAILS, PERSON_RAILS

# Patterns of identifiers, in the order in which they claim their spans.
DETECTORS = (
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("AADHAAR", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("GSTIN", r"\b\d{2}[A-Z]{5}\d{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b"),
    ("CARD_NUMBER", r"\b(?:\d[ -]?){12,18}\d\b"),
    ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("UPI_ID", r"\b[\w][\w.\-]{1,63}@[a-zA-Z][a-zA-Z0-9]{1,63}\b"),
    ("PHONE", r"(?<!\d)(?:\+?91[\s-]?)?[6-9]\d{9}(?!\d)"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("ACCOUNT_NUMBER", r"(?<!\d)\d{9,18}(?!\d)"),
    ("LONG_DIGIT_RUN", r"(?<!\d)\d{6,}(?!\d)"),
)
MONETARY = (
    "MONETARY",
    r"(?i)(?:(?:₹|INR|Rs\.?)\s*[\d,]+(?:\.\d{1,2})?)|(?<![\w.])\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?(?![\w.])|(?<![\w.])\d+\.\d{2}(?![\w.])",
)

# Injection patterns by name, in the order in which they are tried.
INJECTIONS = (
    ("instruction_override", r"\b(?:ignore|disregard|forget|override|bypass)\b[^.]{0,40}\b(?:previous|prior|earlier|above|all|any|system|instruction|prompt|rule)"),
    ("role_injection", r"\b(?:system|assistant|user|developer)\s*[:>\]]|<\s*/?\s*(?:system|assistant|user|instruction|untrusted_data)\s*>|\[/?INST\]|<\|[^|]{0,20}\|>"),
    ("behaviour_directive", r"\byou\s+(?:are|must|should|will|shall)\b|\bact\s+as\b|\bpretend\b|\brespond\s+with\b|\breply\s+with\b|\boutput\s+(?:the|all|only)\b|\bprint\s+(?:the|all)\b|\breveal\b|\bdisclose\b|\bexfiltrat"),
    ("data_exfiltration", r"\bselect\s+.{0,30}\bfrom\b|\bdrop\s+table\b|\bunion\s+select\b|\b(?:api|secret|private)[\s_-]?key\b|\bpassword\b|\btoken\b|\benv(?:ironment)?\s+var|\bos\.|\bsubprocess\b|\bimport\s+os\b"),
    ("markup_injection", r'```|~~~|<script|javascript:|data:text/html|"function_call"|"tool_call"|<function|\{\s*"name"\s*:'),
    ("embedded_url", r"https?://|www\.\w|\b\w+\.(?:com|net|org|io|ai|co)\b"),
)
LONGEST_SAFE = 160


def luhn_valid(digits: Column) -> Column:
    """13 to 19 digits with a right Luhn sum; separators are taken out first."""
    bare = F.regexp_replace(digits, r"\D", "")
    return F.length(bare).between(13, 19) & F.call_function("luhn_check", bare)


def _verhoeff_tables() -> tuple[list[int], list[int]]:
    """Verhoeff's checksum from its rules: the dihedral group of ten, and powers of one permutation."""
    product = [[(a + b) % 5 if a < 5 and b < 5 else 5 + (a + b - 5) % 5 if a < 5 else 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([step[x] for x in rows[-1]])
    return sum(product, []), sum(rows, [])


PRODUCT, PERMUTATION = _verhoeff_tables()


def verhoeff_valid(digits: Column) -> Column:
    """Twelve digits, the first neither 0 nor 1, with a right Verhoeff sum."""
    bare = F.regexp_replace(digits, r"\D", "")
    numbers = F.transform(F.filter(F.split(F.reverse(bare), ""), lambda d: d != ""), lambda d: d.cast("int"))
    product, permutation = F.array(*map(F.lit, PRODUCT)), F.array(*map(F.lit, PERMUTATION))
    moved = F.transform(numbers, lambda d, i: F.get(permutation, (i % 8) * 10 + d))
    total = F.aggregate(moved, F.lit(0), lambda a, d: F.get(product, a * 10 + d))
    return F.when(bare.rlike(r"^[2-9]\d{11}$"), total == 0).otherwise(F.lit(False))


def _luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def _verhoeff(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total = PRODUCT[total * 10 + PERMUTATION[(i % 8) * 10 + int(d)]]
    return len(digits) == 12 and digits[0] not in "01" and total == 0


_CHECKS = {"CARD_NUMBER": _luhn, "AADHAAR": _verhoeff}
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def spans_of(text: str, detectors=DETECTORS) -> list[tuple[str, int, int]]:
    """Sensitive spans in order; of overlapping ones the earlier detector's stays."""
    found: list[tuple[str, int, int]] = []
    for kind, pattern in detectors:
        for m in re.finditer(pattern, text):
            if kind in _CHECKS and not _CHECKS[kind](re.sub(r"\D", "", m[0])):
                continue
            if not any(m.start() < end and start < m.end() for _, start, end in found):
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: s[1])


@F.pandas_udf(T.ArrayType(SPAN))
def scan(texts: pd.Series) -> pd.Series:
    """Spans of each text; a null or empty text has none."""
    return texts.fillna("").map(lambda t: [{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)] if _suspect(t) else [])


def _suspect(text: str) -> bool:
    return "@" in text or any(c.isdigit() for c in text)


def _redacted(text: str, detectors) -> str:
    out, at = [], 0
    for kind, start, end in spans_of(text, detectors) if _suspect(text) else []:
        out += [text[at:start], f"[REDACTED:{kind}]"]
        at = end
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def redact(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _redacted(t, DETECTORS))


@F.pandas_udf(T.StringType())
def redact_for_logs(texts: pd.Series) -> pd.Series:
    """As redact(), and without amounts."""
    return texts.map(lambda t: None if t is None else _redacted(t, (MONETARY, *DETECTORS)))


def log_record(allowed: list[str], exempt: list[str]):
    """A function of log records as JSON objects: allowed keys stay, the others' names are listed under dropped_fields, and all text
    below a key that is not exempt is redacted, in lists and objects of any depth. Null for what is no object."""

    def clean(value):
        if isinstance(value, str):
            return _redacted(value, (MONETARY, *DETECTORS))
        if isinstance(value, list):
            return [clean(v) for v in value]
        return {k: clean(v) for k, v in value.items()} if isinstance(value, dict) else value

    def written(text: str | None) -> str | None:
        try:
            record = json.loads(text or "")
        except ValueError:
            return None
        if not isinstance(record, dict):
            return None
        kept = {k: v if k in exempt else clean(v) for k, v in record.items() if k in allowed}
        dropped = sorted(k for k in record if k not in allowed)
        return json.dumps(kept | ({"dropped_fields": dropped} if dropped else {}), ensure_ascii=False)

    return F.pandas_udf(lambda texts: texts.map(written), T.StringType())


_WORD, _BLANK = "[A-Za-z0-9_]", r"\t\n\f\r "
_AS_ASCII = {r"\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", r"\s": f"[{_BLANK}]", "s": "[s\u017f]", "k": "[k\u212a]"}


def _portable(pattern: str) -> str:
    """An injection pattern for Java's engine, to the sense it has in RE2 whatever the Java version: ends of words and blanks are
    ASCII's, a dot passes all but a line feed, and letters in either case include the long s and the Kelvin sign."""
    piece = lambda m: m[0].replace(r"\s", _BLANK) if m[0][0] == "[" else _AS_ASCII.get(m[0].lower(), m[0])
    return "(?id)" + re.sub(r"\\.|\[(?:\\.|[^\]])*\]|[sSkK]", piece, pattern)


def injection_reason(text: Column) -> Column:
    """Why a text must not reach a model, or null; the first reason wins."""
    found = F.when(text.rlike("[\\x00-\\x1F\\u200B-\\u200F]"), "hidden_characters")
    for name, pattern in reversed(INJECTIONS):
        found = F.when(text.rlike(_portable(pattern)), name).otherwise(found)
    return F.when((text != ""), F.when(F.char_length(text) > LONGEST_SAFE, "oversized_text").otherwise(found))


def merchant_sendable(merchant: Column, known: Column, rail: Column, description: Column) -> Column:
    """Whether a merchant's name may leave: known ones may; else by rail, and on UPI only with a mark of payment to a business."""
    marked = F.upper(description).rlike("/P2M/|-P2M-| P2M ")
    by_rail = F.when(rail.isin(*PERSON_RAILS), False).when(rail.isin(*MERCHANT_RAILS), True).otherwise((rail == "upi") & marked)
    return F.when(F.coalesce(merchant, F.lit("")) == "", False).otherwise(F.coalesce(known, F.lit(False)) | by_rail)


def allowed_details(details: Column, keys: list[str]) -> tuple[Column, Column]:
    """A map without keys that are not allowed, and the names that were dropped."""
    allowed = F.array(*map(F.lit, keys))
    return F.map_filter(details, lambda k, _: F.array_contains(allowed, k)), F.array_sort(F.array_except(F.map_keys(details), allowed))


# How figures are written, currency before percentages before bare numbers, and the numerals that are checked.
FIGURE = r"(?iU)(?:₹|\bRs\.?|\bINR)\s*[0-9][0-9,]*(?:\.[0-9]+)?|[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:%|per\s?cent)|(?<![\d,.\w])[0-9][0-9,]*(?:\.[0-9]+)?"
NUMERALS = (
    "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen", "twenty",
)
YEAR = r"^(?:19\d\d|20\d\d|2100)$"


def figures(text: Column) -> Column:
    """The figures that a text writes in digits, in order: kind (currency, percentage or figure), value without commas and idle zeros, and text."""
    number = lambda t: F.regexp_replace(F.regexp_extract(t, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "")
    value = lambda t: F.regexp_replace(F.regexp_replace(number(t), r"(\.[0-9]*?)0+$|^0+(?=[0-9])", "$1"), r"\.$", "")
    kind = lambda t: F.when(t.rlike("(?i)^(?:₹|rs|inr)"), "currency").when(t.rlike("(?i)(?:%|cent)$"), "percentage").otherwise("figure")
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIGURE), 0)
    return F.transform(tokens, lambda t: F.struct(kind(t).alias("kind"), value(t).alias("value"), t.alias("text")))


def numerals(text: Column) -> Column:
    """The numerals from two to twenty that a text writes out, as figures() has them; one is left out, being a pronoun more often."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?iU)\b(?:{'|'.join(NUMERALS)})\b"), 0)
    names = F.array(*map(F.lit, NUMERALS))
    value = lambda w: (F.array_position(names, F.lower(w)) + 1).cast("string")
    return F.transform(words, lambda w: F.struct(F.lit("word_number").alias("kind"), value(w).alias("value"), w.alias("text")))


def untraceable(answer: Column, allowed: Column) -> Column:
    """Figures of an answer that the allowed text doesn't have, as kind:text, in order and each time.

    Currency must be there as currency and percentages as percentages; bare numbers and numerals may be there as anything.
    Bare years from 1900 to 2100 pass.
    """
    told = figures(allowed)
    of = lambda kind: F.transform(F.filter(told, lambda t: t["kind"] == kind), lambda t: t["value"])
    any_kind = F.transform(told, lambda t: t["value"])
    there = lambda f: (
        F.when(f["kind"] == "currency", F.array_contains(of("currency"), f["value"]))
        .when(f["kind"] == "percentage", F.array_contains(of("percentage"), f["value"]))
        .otherwise(F.array_contains(any_kind, f["value"]) | ((f["kind"] == "figure") & f["value"].rlike(YEAR)))
    )
    found = F.filter(F.concat(figures(answer), numerals(answer)), lambda f: ~there(f))
    return F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["text"]))
