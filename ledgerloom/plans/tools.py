"""The read interface: typed tools over the analytics, and a rule-based planner from questions to tools."""

from __future__ import annotations

import json
import re
from calendar import month_name, monthrange
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import anomaly as N
from ..operators import recurring as R
from ..schema import TOOL_ROWS


@dataclass(frozen=True)
class Period:
    first: date
    last: date
    label: str
    is_month: bool


def month_period(month: date) -> Period:
    first = month.replace(day=1)
    return Period(first, first.replace(day=monthrange(first.year, first.month)[1]), f"{month_name[first.month]} {first.year}", True)


def parse_period(value: str | None, default: date) -> Period:
    """YYYY-MM or YYYY from 1990 to 2100; without a value the default's month. Anything else raises an error."""
    if value is None or not value.strip():
        return month_period(default)
    m = re.fullmatch(r"(\d{4})(?:-(\d{2}))?", value.strip())
    if not m or not 1990 <= int(m[1]) <= 2100 or (m[2] and not 1 <= int(m[2]) <= 12):
        raise ValueError("a period is YYYY-MM or YYYY, from 1990 to 2100")
    if m[2]:
        return month_period(date(int(m[1]), int(m[2]), 1))
    return Period(date(int(m[1]), 1, 1), date(int(m[1]), 12, 31), m[1], False)


def _within(ledger: DataFrame, p: Period) -> DataFrame:
    return ledger.where(F.col("txn_date").between(F.lit(p.first), F.lit(p.last)))


def get_monthly_spending(ledger: DataFrame, default: date, month: str | None = None) -> DataFrame:
    return A.monthly_summary(_within(ledger, parse_period(month, default)))


def get_category_spending(ledger: DataFrame, default: date, period: str | None = None, category: str | None = None) -> DataFrame:
    """Shares are of the period's largest 30 categories; a category is picked after they are taken."""
    first = F.lit(parse_period(period, default).first)
    rows = _within(ledger, parse_period(period, default)).withColumn("txn_date", first)  # the whole period as one
    rows = A.category_breakdown(rows)
    return rows if category is None else rows.where(F.col("slug") == category)


def get_transactions(ledger: DataFrame, default: date, period: str | None = None, limit: int = 10, **conditions) -> DataFrame:
    if not 1 <= limit <= TOOL_ROWS:
        raise ValueError(f"limit is from 1 to {TOOL_ROWS}")
    p = parse_period(period, default)
    if "merchant" in conditions:
        conditions["merchant_like"] = conditions.pop("merchant")
    which = A.LedgerFilter(date_from=p.first, date_to=p.last, **conditions)
    return A.page(ledger, which, limit)


def get_top_merchants(ledger: DataFrame, default: date, period: str | None = None, limit: int = 10) -> DataFrame:
    return A.top_merchants(_within(ledger, parse_period(period, default)), limit)


def get_recurring_expenses(ledger: DataFrame, default: date) -> DataFrame:
    return R.subscriptions(ledger, month_period(default).last).where("status = 'active'")


def compare_months(ledger: DataFrame, default: date, left: str, right: str, category: str | None = None) -> DataFrame:
    """The ten largest changes that are not zero; a category is marked, not filtered."""
    a, b = parse_period(left, default), parse_period(right, default)
    rows = A.compare_months(ledger, a.first, b.first).where("change <> 0").withColumn("in_focus", F.col("slug").eqNullSafe(F.lit(category)))
    return rows.orderBy(F.desc(F.abs("change")), "tenant_id", "slug").limit(10)


def get_anomalies(ledger: DataFrame, default: date, limit: int = 10, keep: N.Keep | None = None) -> DataFrame:
    month = month_period(default).first
    return N.sweep(ledger, keep).where(F.col("month") == F.lit(month)).orderBy(F.desc_nulls_last("deviation"), F.desc("observed"), "txn_id").limit(limit)


TOOLS = {
    f.__name__: f
    for f in (get_monthly_spending, get_category_spending, get_transactions, get_top_merchants, get_recurring_expenses, compare_months, get_anomalies)
}


def execute(ledger: DataFrame, default: date, tool: str, arguments: dict) -> DataFrame:
    """Runs a tool by name; an unknown name or argument raises an error before anything is read."""
    if tool not in TOOLS:
        raise ValueError("no such tool")
    return TOOLS[tool](ledger, default, **arguments)


# Words by which the planner knows what a question asks for, in the order of its rules.
SUBSCRIPTION_WORDS = ("subscription", "recurring", "renew", "monthly charge", "direct debit")
ANOMALY_WORDS = ("unusual", "strange", "odd", "outlier", "stands out", "stand out", "anything wrong", "suspicious", "spike")
COMPARE_WORDS = (
    "compare", "comparison", " vs ", "versus", "why did", "why has", "increase", "increased", "decrease", "decreased", "go up", "went up",
    "gone up", "went down", "change", "changed", "more than last", "less than last",
)
MERCHANT_WORDS = ("top merchant", "which merchant", "where did", "where is my money", "most money", "biggest merchant", "who did i pay", "top shops")
LIST_WORDS = ("show me", "list", "transactions", "which transactions", "what did i buy")
SPEND_WORDS = ("how much", "spend", "spent", "spending", "total", "income", "savings", "cash flow", "earn")
UNITS = {"k": 1_000, "thousand": 1_000, "lakh": 100_000, "lakhs": 100_000}
MONTHS = {name[:n].lower(): i for i, name in enumerate(month_name) if i for n in (3, len(name))}


# Shapes of months, years and bounds in a question.
ISO_MONTH = re.compile(r"\b(20\d{2})-(0[1-9]|1[0-2])\b")
NAMED_MONTH = re.compile(rf"\b({'|'.join(sorted(MONTHS, key=len, reverse=True))})\b(?:\s+(20\d{{2}}))?", re.IGNORECASE)
YEAR = re.compile(r"\b20\d{2}\b")
BOUND = re.compile(
    r"(?P<side>above|over|more than|greater than|at least|below|under|less than)\s*(?:₹|rs\.?|inr)?\s*(?P<digits>\d[\d,]*(?:\.\d+)?)\s*(?P<unit>k|thousand|lakhs?)?\b",
    re.IGNORECASE,
)
UPPER_SIDES = ("below", "under", "less than")


@dataclass(frozen=True)
class Question:
    """A question and what it names, each found once when it is asked for."""

    text: str
    default: date
    categories: dict[str, str]
    merchants: list[str]

    @cached_property
    def padded(self) -> str:
        return f" {self.text.lower()} "

    def says(self, *words: str) -> bool:
        return any(w in self.padded for w in words)

    def month(self, back: int = 0) -> str:
        """The default month, or one before it."""
        at = self.default.year * 12 + self.default.month - 1 - back
        return f"{at // 12}-{at % 12 + 1:02}"

    @cached_property
    def months(self) -> list[str]:
        """Months in the order in which they stand; one without a year is the latest that has come."""
        spans = {m.start(): f"{m[1]}-{m[2]}" for m in ISO_MONTH.finditer(self.text)}
        for m in NAMED_MONTH.finditer(self.text):
            number = MONTHS[m[1].lower()]
            spans[m.start()] = f"{m[2] or self.default.year - (number > self.default.month)}-{number:02}"
        return list(dict.fromkeys(spans[at] for at in sorted(spans)))

    @cached_property
    def period(self) -> str:
        """The period that the question is about: the first of these that it names, else the default month."""
        iso, year = ISO_MONTH.search(self.text), YEAR.search(self.text)
        named = (
            (iso, lambda: iso[0]),
            (self.says("last year", "previous year"), lambda: str(self.default.year - 1)),
            (self.says("this year", "the year"), lambda: str(self.default.year)),
            (self.months, lambda: self.months[0]),
            (year, lambda: year[0]),
            (self.says("last month", "previous month"), lambda: self.month(1)),
        )
        return next((value() for found, value in named if found), self.month())

    @cached_property
    def bound(self) -> dict:
        """The least or greatest amount asked for, in whole units."""
        m = BOUND.search(self.text)
        if not m:
            return {}
        amount = Decimal(m["digits"].replace(",", "")) * UNITS.get((m["unit"] or "").lower(), 1)
        return {"max_amount" if m["side"].lower() in UPPER_SIDES else "min_amount": Decimal(int(amount))}

    @cached_property
    def category(self) -> dict:
        """The category whose name or slug is the longest in the question."""
        called = {slug: max((len(c) for c in (slug.replace("_", " "), name.lower()) if self.says(f" {c} ")), default=0) for slug, name in self.categories.items()}
        best = max(called.items(), key=lambda x: (x[1], x[0]), default=("", 0))
        return {"category": best[0]} if best[1] else {}

    @cached_property
    def merchant(self) -> dict:
        known = [m for m in self.merchants if len(m) >= 3 and self.says(m.lower())]
        return {"merchant": max(known, key=len)} if known else {}


def _both_months(q: Question) -> dict:
    left, right = q.months[:2] if len(q.months) > 1 else (q.month(1), q.month())
    return {"left": left, "right": right} | q.category


def _listed(*parts: str):
    """Arguments of a tool with a period and ten rows, and what the question names besides."""
    return lambda q: {k: v for part in parts for k, v in getattr(q, part).items()} | {"period": q.period, "limit": 10}


#: What decides, in order: whether a question meets the rule, the tool, and its arguments.
PLANS = (
    (lambda q: q.says(*SUBSCRIPTION_WORDS), "get_recurring_expenses", lambda q: {}),
    (lambda q: q.says(*ANOMALY_WORDS), "get_anomalies", lambda q: {"limit": 10}),
    (lambda q: q.says(*COMPARE_WORDS), "compare_months", _both_months),
    (lambda q: q.bound, "get_transactions", _listed("bound", "category")),
    (lambda q: q.merchant, "get_transactions", _listed("merchant")),
    (lambda q: q.category, "get_category_spending", lambda q: q.category | {"period": q.period}),
    (lambda q: q.says(*MERCHANT_WORDS), "get_top_merchants", _listed()),
    (lambda q: q.says(*LIST_WORDS), "get_transactions", _listed()),
    (lambda q: q.says(*SPEND_WORDS) and len(q.period) == 4, "get_category_spending", lambda q: {"period": q.period}),
    (lambda q: q.says(*SPEND_WORDS), "get_monthly_spending", lambda q: {"month": q.period}),
)


def plan(question: str, default: date, categories: dict[str, str], merchants: list[str]) -> tuple[str, dict] | None:
    """Tool and arguments for a question, by the first rule of PLANS that it meets; None is a refusal.

    categories: names by slug; merchants: those of the tenant's ledger.
    """
    q = Question(question or "", default, categories, merchants)
    return next(((tool, arguments(q)) for meets, tool, arguments in PLANS if q.text.strip() and meets(q)), None)


# The questions offered, by id, with the tool that each runs.
SUGGESTIONS = {
    "month_summary": ("How much did I spend this month?", "get_monthly_spending"),
    "by_category": ("What did I spend it on?", "get_category_spending"),
    "top_merchants": ("Where did most of my money go?", "get_top_merchants"),
    "subscriptions": ("What subscriptions do I have?", "get_recurring_expenses"),
    "month_change": ("Why did my spending change?", "compare_months"),
    "large": ("Show me transactions above ₹10,000", "get_transactions"),
    "unusual": ("Is anything unusual?", "get_anomalies"),
}
LARGE = 10_000


def suggested(name: str, default: date) -> tuple[str, dict] | None:
    """Tool and arguments of an offered question for a month; its words are not read. None for an unknown id."""
    if name not in SUGGESTIONS:
        return None
    q, tool = Question("", default, {}, []), SUGGESTIONS[name][1]
    extra = {"get_transactions": {"min_amount": LARGE}, "compare_months": {"left": q.month(1), "right": q.month()}}
    takes = {"get_monthly_spending": ("month",), "get_category_spending": ("period",), "get_top_merchants": ("period", "limit"), "get_transactions": ("period", "limit"), "get_anomalies": ("limit",)}
    common = {"month": q.month(), "period": q.month(), "limit": 10}
    return tool, {k: common[k] for k in takes.get(tool, ())} | extra.get(tool, {})


def suggestions_for(ledger: DataFrame) -> DataFrame:
    """tenant_id, id, tool and arguments (JSON) of the questions offered to each tenant, for its latest month with rows."""
    this, before = "{month}", "{month before}"
    latest = ledger.groupBy("tenant_id").agg(F.trunc(F.max("txn_date"), "MM").alias("month"))
    offers = []
    for name in SUGGESTIONS:
        tool, arguments = suggested(name, date(2000, 2, 1))
        marked = {k: {"2000-02": this, "2000-01": before}.get(v, v) if isinstance(v, str) else v for k, v in arguments.items()}
        text = F.replace(F.lit(json.dumps(marked, default=int)), F.lit(this), F.date_format("month", "yyyy-MM"))
        text = F.replace(text, F.lit(before), F.date_format(F.add_months("month", -1), "yyyy-MM"))
        offers.append(F.struct(F.lit(name).alias("id"), F.lit(tool).alias("tool"), text.alias("arguments")))
    return latest.select("tenant_id", F.explode(F.array(*offers)).alias("o")).select("tenant_id", "o.*")


MOST_MONTHS, MOST_ROWS = 36, 50


def insight(ledger: DataFrame, name: str, month: date, months: int = 12, limit: int = 10) -> DataFrame:
    """The insight reads by name: daily, trend, compare and top_merchants of a month; months is 1 to 36 and limit 1 to 50."""
    if not 1 <= months <= MOST_MONTHS or not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"months is from 1 to {MOST_MONTHS}, limit from 1 to {MOST_ROWS}")
    here = month_period(month)
    before = date(month.year - (month.month == 1), (month.month - 2) % 12 + 1, 1)
    reads = {
        "daily": lambda: A.daily_series(_within(ledger, here), here.first),
        "trend": lambda: A.trend(ledger, here.first, months),
        "compare": lambda: A.compare_months(ledger, before, here.first),
        "top_merchants": lambda: A.top_merchants(_within(ledger, here), limit),
    }
    if name not in reads:
        raise ValueError("no such insight")
    return reads[name]()
