"""Ledger operators on literal rows: independent recomputation, rules at their edges, and metamorphic checks."""

from __future__ import annotations

import random
import statistics
from datetime import date, timedelta
from decimal import ROUND_HALF_EVEN
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money as M
from ledgerloom.operators import analytics as A
from ledgerloom.operators import anomaly as N
from ledgerloom.operators import maintenance as U
from ledgerloom.operators import movement as J
from ledgerloom.operators import recurring as R
from ledgerloom.operators import trust as T
from ledgerloom.schema import LEDGER_SCHEMA


def ledger(spark, rows):
    """rows: (txn_id, date, amount, direction, movement, is_expense, merchant, category) and keyword overrides."""
    made = []
    for r in rows:
        txn, day, amount, way, kind, spent, merchant, category, *rest = r
        own = {"tenant_id": 1, "account_id": 1, "statement_id": 1, "trust_status": "trusted", "review_status": "approved"} | (rest[0] if rest else {})
        made.append((own["tenant_id"], txn, own["account_id"], own["statement_id"], date.fromisoformat(day), D(amount), way, kind, spent, merchant, category, own["trust_status"], own["review_status"]))
    return spark.createDataFrame(made, LEDGER_SCHEMA)


def spend(txn, day, amount, merchant="m", category="c", **own):
    return (txn, day, amount, "debit", "expense", True, merchant, category, own)


def test_monthly_summary_adds_up(spark):
    rows = [
        spend("a", "2024-03-01", "100.10"), spend("b", "2024-03-31", "50.05", trust_status=None),
        ("c", "2024-03-05", "1000.00", "credit", "salary", False, None, None), ("d", "2024-03-06", "20.15", "credit", "refund", False, "m", "c"),
        ("e", "2024-03-07", "500.00", "debit", "transfer", False, None, None, {"review_status": "review_required"}),
    ]
    row = A.monthly_summary(ledger(spark, rows)).collect()[0]
    assert (row.expenses, row.income, row.refunds, row.transfers) == (D("150.15"), D("1000.00"), D("20.15"), D("500.00"))
    assert (row.net_expenses, row.net_cash_flow, row.savings_rate) == (D("130.00"), D("870.00"), D("0.8700"))
    assert (row.untrusted, row.awaiting_review, row.fully_trusted, row.transaction_count) == (1, 1, False, 5)


def test_savings_rate_is_zero_without_income_and_never_negative(spark):
    rows = [spend("a", "2024-03-01", "10"), spend("b", "2024-04-01", "10"), ("c", "2024-04-02", "5", "credit", "income", False, None, None)]
    assert [r.savings_rate for r in A.monthly_summary(ledger(spark, rows)).orderBy("month").collect()] == [D("0.0000"), D("0.0000")]


def test_no_tenant_sees_nothing(spark):
    rows = ledger(spark, [spend("a", "2024-03-01", "10")])
    assert A.scoped(rows, None).count() == 0 and A.scoped(rows, 2).count() == 0 and A.scoped(rows, 1).count() == 1


def test_trend_fills_months_and_daily_series_sums_to_the_month(spark):
    rows = ledger(spark, [spend("a", "2024-01-10", "10"), spend("b", "2024-03-10", "30.30"), spend("c", "2024-03-11", "1.01")])
    months = A.trend(rows, date(2024, 3, 5), 3).orderBy("month").collect()
    assert [(str(m.month), m.expenses) for m in months] == [("2024-01-01", D("10.00")), ("2024-02-01", D("0.00")), ("2024-03-01", D("31.31"))]
    days = A.daily_series(rows, date(2024, 3, 5)).collect()
    assert len(days) == 31 and sum(d.expenses for d in days) == D("31.31")


def test_shares_are_of_the_rows_returned(spark):
    rows = ledger(spark, [spend("a", "2024-03-01", "60", category="x"), spend("b", "2024-03-01", "30", category="y"), spend("c", "2024-03-01", "10", category=None)])
    got = {r.slug: r.share for r in A.category_breakdown(rows, limit=2).collect()}
    assert got == {"x": D("0.6667"), "y": D("0.3333")}
    assert "uncategorised" in {r.slug for r in A.category_breakdown(rows).collect()}


def test_compare_months_has_no_percentage_on_a_zero_base(spark):
    rows = ledger(spark, [spend("a", "2024-02-01", "50", category="x"), spend("b", "2024-03-01", "75", category="x"), spend("c", "2024-03-01", "5", category="y")])
    got = {r.slug: (r.change, r.percent_change) for r in A.compare_months(rows, date(2024, 2, 1), date(2024, 3, 1)).collect()}
    assert got == {"x": (D("25.00"), D("0.5000")), "y": (D("5.00"), None)}


def test_top_merchants_take_the_most_frequent_category_and_the_lowest_of_equals(spark):
    rows = ledger(spark, [spend("a", "2024-03-01", "1", category="z"), spend("b", "2024-03-01", "1", category="a"), spend("c", "2024-03-01", "1", category=None)])
    assert A.top_merchants(rows).collect()[0].category == "a"


def test_filter_combines_and_escapes_nothing(spark):
    rows = ledger(spark, [spend("a", "2024-03-01", "5", merchant="Shop_1"), spend("b", "2024-03-02", "15", merchant="ShopX1")])
    assert A.totals(rows, A.LedgerFilter(merchant_like="shop_1")).collect()[0].n == 2  # _ is a wildcard
    assert [r.txn_id for r in A.page(rows, A.LedgerFilter(min_amount=D("10"))).collect()] == ["b"]


@pytest.mark.parametrize(("amount", "shown"), [("0.5", "₹0.50"), ("999", "₹999.00"), ("1000", "₹1,000.00"), ("123456.789", "₹1,23,456.79"), ("-10000000", "₹1,00,00,000.00")])
def test_grouping(spark, amount, shown):
    assert spark.range(1).select(M.grouped(F.lit(amount).cast("decimal(18,3)"))).first()[0] == shown


def test_rounding_half_even_for_money_and_half_up_for_display(spark):
    row = spark.range(1).select(M.money(F.lit("0.125").cast("decimal(6,3)")), M.rupees(F.lit("2.5").cast("decimal(6,2)")), M.bucket(F.lit("-100").cast("decimal(18,2)"))).first()
    assert tuple(row) == (D("0.12"), D("3"), "100_500")


def test_outlier_needs_history_and_spread(spark):
    past = [spend(f"p{i}", f"2024-01-{i + 1:02}", str(90 + 5 * i)) for i in range(5)]  # median 100, deviations 10 5 0 5 10
    flat = [spend(f"f{i}", f"2024-01-{i + 1:02}", "100", category="flat") for i in range(5)]
    now = [spend("edge", "2024-02-01", "125.96"), spend("in", "2024-02-01", "125.90"), spend("low", "2024-02-02", "10"), spend("flat", "2024-02-01", "900", category="flat")]
    got = {r.txn_id: (r.robust_z, r.reason) for r in N.amount_outliers(ledger(spark, past + flat + now)).collect()}
    assert set(got) == {"edge", "low"} and got["edge"][0] == D("3.50") and "unusually small" in got["low"][1]


def test_outlier_history_stops_at_200_rows(spark):
    old = [spend(f"o{i:03}", "2023-01-01", "1000000") for i in range(300)]
    recent = [spend(f"r{i:03}", "2023-06-01", str(100 + i % 7)) for i in range(200)]
    got = N.amount_outliers(ledger(spark, old + recent + [spend("x", "2023-07-01", "5000")])).where("txn_id = 'x'").collect()
    assert got[0].baseline == D("103.00")


def test_spike_needs_both_ratio_and_amount(spark):
    def rows(now, base="1000"):
        return ledger(spark, [spend("a", "2024-01-01", base), spend("b", "2024-02-01", base), spend("c", "2024-03-01", now)])

    assert N.category_spikes(rows("3000")).count() == 1
    assert N.category_spikes(rows("2999.99")).count() == 0
    assert N.category_spikes(rows("7000", "4000")).count() == 0


def test_duplicate_charges_within_three_days_but_not_the_same_day(spark):
    rows = ledger(spark, [spend("a", "2024-03-01", "9.99"), spend("b", "2024-03-01", "9.99"), spend("c", "2024-03-04", "9.99"), spend("d", "2024-03-08", "9.99")])
    assert {(r.left_id, r.txn_id) for r in N.duplicate_charges(rows).collect()} == {("a", "c"), ("b", "c")}


def test_first_seen_large(spark):
    past = [spend(f"p{i}", "2024-01-05", "100", merchant="old") for i in range(4)]
    rows = ledger(spark, [*past, spend("n", "2024-02-05", "300", merchant="new"), spend("s", "2024-02-05", "299", merchant="small"), spend("o", "2024-02-06", "900", merchant="old")])
    assert [r.txn_id for r in N.first_seen_large(rows).collect()] == ["n"]


def monthly(merchant, n=4, day=9):
    return [spend(f"{merchant}{i}", f"2024-{i + 1:02}-{day:02}", "499.00", merchant=merchant) for i in range(n)]


def test_monthly_charges_are_a_subscription_on_the_same_day(spark):
    got = R.subscriptions(ledger(spark, monthly("s")), date(2024, 4, 20)).collect()[0]
    assert (got.cadence, str(got.next_expected_on), got.estimated_annual_cost, got.status) == ("monthly", "2024-05-09", D("5988.00"), "active")
    assert R.subscriptions(ledger(spark, monthly("s")), date(2024, 6, 30)).collect()[0].status == "lapsed"


def test_candidates_have_three_charges_since_the_day_and_the_most_frequent_category(spark):
    rows = [*monthly("s"), spend("o", "2023-12-09", "1.00", merchant="s"), *monthly("t", n=2), spend("n", "2024-01-01", "1.00", merchant=None)]
    got = R.candidates(ledger(spark, rows), date(2024, 1, 1)).collect()
    assert [(r.merchant, r.occurrence_count, r.category) for r in got] == [("s", 4, "c")]
    assert R.candidates(ledger(spark, rows), date(2025, 1, 1)).count() == 0


def test_irregular_or_rare_charges_are_not(spark):
    days = ["2024-01-01", "2024-01-08", "2024-02-20", "2024-02-25", "2024-04-01"]
    rows = [spend(f"i{k}", d, "10", merchant="i") for k, d in enumerate(days)] + monthly("two", 2)
    assert R.subscriptions(ledger(spark, rows), date(2024, 4, 20)).count() == 0


def test_month_end_is_clamped(spark):
    got = spark.range(1).select(R.next_charge(F.lit("2024-01-31").cast("date"), F.lit(31), F.lit(1))).first()[0]
    assert str(got) == "2024-02-29"


def test_projection_takes_the_larger_of_rate_and_known_charges(spark):
    rows = ledger(spark, [spend("a", "2024-06-05", "100")])
    subs = spark.createDataFrame([(1, "active", date(2024, 6, 20), D("900.00"))], "tenant_id long, status string, next_expected_on date, typical_amount decimal(18,2)")
    row = R.project_month(rows, subs, date(2024, 6, 1), date(2024, 6, 10)).collect()[0]
    assert (row.run_rate_projection, row.projected_total, row.reliable) == (D("300.00"), D("1000.00"), True)
    past = R.project_month(rows, subs, date(2024, 6, 1), date(2024, 7, 10)).collect()[0]
    assert (past.projected_total, past.upcoming_recurring) == (D("100.00"), D("0.00"))


STATEMENT = "tenant_id long, account_id long, statement_id long, document_type string, period_start date, period_end date, opening_balance decimal(18,2), closing_balance decimal(18,2)"
LINE = "statement_id long, source_row int, source_page int, txn_date date, amount decimal(18,2), direction string, balance_after decimal(18,2)"


def report(spark, kind, opening, closing, lines):
    d = date(2024, 3, 1)
    money = lambda x: None if x is None else D(x)
    whole = spark.createDataFrame([(1, 1, 1, kind, d, date(2024, 3, 31), money(opening), money(closing))], STATEMENT)
    rows = [(1, i, page, date(2024, 3, 5), D(a), way, money(b)) for i, (page, a, way, b) in enumerate(lines)]
    return T.reconcile(whole, spark.createDataFrame(rows, LINE)).collect()[0]


def test_bank_and_card_identities(spark):
    lines = [(1, "30", "debit", None), (1, "10", "credit", None)]
    assert report(spark, "bank_statement", "100", "80", lines).trust_status == "trusted"
    assert report(spark, "bank_statement", "100", "80.01", lines).delta == D("-0.01")
    assert report(spark, "credit_card_statement", "100", "120", lines).trust_status == "trusted"
    assert report(spark, "bank_statement", "100", None, lines).trust_status == "pending"


def test_balance_walk_reports_the_row_after_a_gap_and_missing_pages(spark):
    lines = [(1, "10", "debit", "90"), (1, "5", "debit", None), (4, "10", "debit", "75")]
    row = report(spark, "bank_statement", "100", "75", lines)
    assert (row.balance_checked, row.balance_continuous, row.first_divergent_row, row.missing_pages) == (True, False, 2, [2, 3])


def test_reimport_adds_nothing_and_equal_rows_stay_apart(spark):
    rows = spark.createDataFrame([(1, 1, 7, i, date(2024, 3, 1), D("200.00"), "debit", "SWIGGY") for i in range(2)], "tenant_id long, account_id long, statement_id long, source_row int, txn_date date, amount decimal(18,2), direction string, m string")
    prints = T.fingerprinted(rows, F.col("m"))
    assert prints.select("fingerprint").distinct().count() == 2
    assert T.new_rows(prints, prints).count() == 0 and T.new_rows(prints, prints.limit(0)).count() == 2


def test_transfer_pairs_use_each_row_once(spark):
    out = lambda t, d, a=1: (t, d, "100", "debit", "transfer", False, None, None, {"account_id": a})
    back = lambda t, d, a=2: (t, d, "100", "credit", "transfer", False, None, None, {"account_id": a})
    rows = ledger(spark, [out("a", "2024-03-01"), back("b", "2024-03-03"), out("c", "2024-03-03"), back("d", "2024-03-09")])
    pairs = J.pair_transfers(rows).collect()
    assert len(pairs) == 1 and {pairs[0].txn_id, pairs[0].paired_with} == {"a", "b"}


def test_corrections_leave_the_ledger_and_the_latest_wins(spark):
    rows = ledger(spark, [spend("a", "2024-03-01", "5")])
    fixes = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, "y"), (1, "a", 3, None)], "tenant_id long, txn_id string, seq int, category string")
    fixes = fixes.withColumns({c: F.lit(None).cast(dict(rows.dtypes)[c]) for c in U.CORRECTABLE if c != "category"})
    got = U.corrected(rows, fixes).collect()[0]
    assert (got.category, got.review_status, got.amount) == ("y", "corrected", D("5.00"))


def test_orphan_guards(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key int")
    refused = lambda live, tenants=(1,): U.orphan_report(keys(*range(8)), keys(*live), keys(*tenants)).first().refused
    assert refused(range(7)) is None and refused(range(5)) == "too_many" and refused([]) == "empty_live_set" and refused(range(8), ()) == "no_tenants"


def test_first_seen_medians_equal_a_plain_median(spark):
    rng = random.Random(4)
    day = lambda: date(2024, rng.randint(1, 6), rng.choice([1, 9, 28, 29])) if rng.random() < 0.7 else date(2024, rng.choice([1, 3, 5]), 31)
    spends = [(f"t{i}", day(), D(rng.choice([rng.randint(1, 400), rng.randint(1, 90_000)])) / 100, f"m{rng.randint(0, 60)}") for i in range(300)]
    got = {(r.txn_id, r.baseline) for r in N.first_seen_large(ledger(spark, [spend(t, str(d), str(a), merchant=m) for t, d, a, m in spends])).collect()}
    want, first = set(), {}
    for _, d, _, m in spends:
        first[m] = min(first.get(m, d.replace(day=1)), d.replace(day=1))
    for t, d, a, m in spends:
        month = d.replace(day=1)
        last = date.fromordinal((month + timedelta(days=32)).replace(day=1).toordinal() - 1)
        if month == first[m] and (before := [x for _, y, x, _ in spends if y < last]):
            middle = statistics.median(before).quantize(D("0.01"), ROUND_HALF_EVEN)
            if middle > 0 and a >= middle * 3:
                want.add((t, middle))
    assert got == want and want


def test_transfer_pairs_equal_a_plain_greedy_over_all_rows(spark):
    rng = random.Random(5)
    rows = [
        (f"t{i:03}", str(date(2024, 1, 1) + timedelta(days=rng.randint(0, 120))), rng.choice(["100", "100", "250"]), rng.choice(["debit", "credit"]),
         rng.choice(["transfer", "credit_card_payment", "purchase"]), False, None, None, {"account_id": rng.randint(1, 3)})
        for i in range(160)
    ]
    got = {(r.txn_id, r.paired_with, r.gap_days) for r in J.pair_transfers(ledger(spark, rows)).collect()}
    gap = lambda a, b: abs((date.fromisoformat(a[1]) - date.fromisoformat(b[1])).days)
    both = [(a[1], a[0], gap(a, b), b[0]) for a in rows if a[4] != "purchase" for b in rows if a[2] == b[2] and a[3] != b[3] and a[8] != b[8] and gap(a, b) <= 3]
    taken, want = set(), set()
    for _, a, days, b in sorted(both):
        if not taken & {a, b}:
            taken |= {a, b}
            want.add((a, b, days))
    assert got == want and want


def test_charges_of_one_day_are_gaps_of_no_days(spark):
    weekly = [spend(f"w{i}", str(date(2024, 1, 1) + timedelta(days=7 * i)), str(10 + i), merchant="w") for i in range(12)]
    got = R.subscriptions(ledger(spark, [*weekly, spend("x", "2024-01-08", "99", merchant="w")]), date(2024, 4, 1)).collect()[0]
    assert (got.cadence, got.occurrence_count, got.stability, got.typical_amount, got.last_amount) == ("weekly", 13, D("0.917"), D("16.00"), D("21.00"))
    daily = [spend(f"d{i}-{k}", f"2024-01-{i + 1:02}", "5", merchant="d") for i in range(3) for k in range(4)]
    assert R.subscriptions(ledger(spark, daily), date(2024, 2, 1)).count() == 0
