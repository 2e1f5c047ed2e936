"""Exact money: rounding, ratios, display and buckets. Money is decimal(18,2) everywhere; floats never are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AMOUNT_BUCKETS, TOP_BUCKET


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Two places, half to even; null counts as zero."""
    return F.coalesce(F.bround(_col(c), 2), F.lit(0)).cast("decimal(18,2)")


def ratio(a: Column | str, b: Column | str, places: int = 4) -> Column:
    """a / b, half to even; null where b is not above zero."""
    a, b = _col(a).cast("decimal(20,2)"), _col(b).cast("decimal(20,2)")
    return F.when(b > 0, F.bround(a / b, places)).cast(f"decimal(18,{places})")


def rupees(c: Column | str) -> Column:
    """Whole rupees, half up."""
    return F.round(_col(c), 0).cast("decimal(18,0)")


def percent(c: Column | str) -> Column:
    """A share as whole percent, half up."""
    return F.round(_col(c) * 100, 0).cast("int")


def grouped(c: Column | str, places: int = 2) -> Column:
    """Indian digit grouping with the rupee sign; the sign of the amount is dropped."""
    shown = F.abs(F.bround(_col(c), places)).cast(f"decimal(18,{places})").cast("string")
    whole, rest = F.substring_index(shown, ".", 1), F.regexp_extract(shown, r"(\.\d+)$", 1)
    lakhs = F.regexp_replace(whole, r"(?<=\d)(?=(\d\d)*\d{3}$)", ",")
    return F.concat(F.lit("₹"), lakhs, rest)


def signed(amount: Column | str = "amount", direction: Column | str = "direction") -> Column:
    """Debits below zero."""
    return F.when(_col(direction) == "debit", -_col(amount)).otherwise(_col(amount)).cast("decimal(18,2)")


def bucket(c: Column | str) -> Column:
    """The coarse size of an amount, by half-open ranges of its absolute value; null stays null."""
    value, found = F.abs(_col(c)), None
    for edge, name in AMOUNT_BUCKETS:
        found = F.when(value < edge, name) if found is None else found.when(value < edge, name)
    return F.when(value.isNotNull(), found.otherwise(TOP_BUCKET))


def exact_median(values: Column) -> Column:
    """The median of an array of decimals: the middle one, or the mean of the two middle ones."""
    ordered, n = F.sort_array(values), F.size(values)
    low, high = F.get(ordered, ((n - 1) / 2).cast("int")), F.get(ordered, (n / 2).cast("int"))
    return ((low + high) / 2).cast("decimal(20,4)")


def cost_estimate(tokens_in: Column, tokens_out: Column, price_in: float | str, price_out: float | str) -> Column:
    """Price of a call, six places, from prices per million tokens."""
    total = tokens_in * F.lit(str(price_in)).cast("decimal(12,6)") + tokens_out * F.lit(str(price_out)).cast("decimal(12,6)")
    return F.bround(total / 1_000_000, 6).cast("decimal(12,6)")
