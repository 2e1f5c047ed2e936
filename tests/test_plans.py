"""Tools, planner, cascade, scorecards, statement text, files and streams."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import token_set_ratio
from ledgerloom.operators import categorize as C
from ledgerloom.plans import tools as Q
from ledgerloom.queries import QUERIES
from ledgerloom.sources import adapters as S
from ledgerloom.sources import statement_json as J
from ledgerloom.sources import statement_text as X
from ledgerloom.streaming import jobs as T
from tests.test_ledger import ledger, spend

MARCH = date(2025, 3, 1)
PLAN = lambda q: Q.plan(q, MARCH, {"food": "Food", "credit_card_payment": "Credit card payment"}, ["Swiggy", "Swiggy Instamart"])


@pytest.mark.parametrize(
    ("question", "planned"),
    [
        ("What subscriptions do I have?", ("get_recurring_expenses", {})),
        ("Anything unusual?", ("get_anomalies", {"limit": 10})),
        ("Compare January and February 2025", ("compare_months", {"left": "2025-01", "right": "2025-02"})),
        ("Why did food go up?", ("compare_months", {"left": "2025-02", "right": "2025-03", "category": "food"})),
        ("transactions above ₹10,000 in April", ("get_transactions", {"min_amount": D(10000), "period": "2024-04", "limit": 10})),
        ("show me payments under 2 lakh", ("get_transactions", {"max_amount": D(200000), "period": "2025-03", "limit": 10})),
        ("How much at swiggy instamart?", ("get_transactions", {"merchant": "Swiggy Instamart", "period": "2025-03", "limit": 10})),
        ("spending on food last year", ("get_category_spending", {"category": "food", "period": "2024"})),
        ("where did my money go in 2024-12", ("get_top_merchants", {"period": "2024-12", "limit": 10})),
        ("list everything", ("get_transactions", {"period": "2025-03", "limit": 10})),
        ("how much did I spend last month", ("get_monthly_spending", {"month": "2025-02"})),
        ("how much did I spend in 2023", ("get_category_spending", {"period": "2023"})),
        ("tell me a joke", None), ("", None),
    ],
)
def test_planner(question, planned):
    assert PLAN(question) == planned


def test_periods_are_never_guessed():
    assert Q.parse_period(None, MARCH).label == "March 2025" and Q.parse_period("2024", MARCH).last == date(2024, 12, 31)
    for wrong in ("2025-13", "1980", "March", "2025-3"):
        with pytest.raises(ValueError, match="period"):
            Q.parse_period(wrong, MARCH)


def test_tools_refuse_what_they_do_not_know(spark):
    rows = ledger(spark, [spend("a", "2025-03-01", "5")])
    with pytest.raises(ValueError, match="no such tool"):
        Q.execute(rows, MARCH, "drop_table", {})
    with pytest.raises(TypeError):
        Q.execute(rows, MARCH, "get_monthly_spending", {"sql": "1"})
    with pytest.raises(ValueError, match="limit"):
        Q.execute(rows, MARCH, "get_transactions", {"limit": 26})
    assert Q.execute(rows, MARCH, "get_transactions", {"merchant": "M"}).count() == 1


def test_token_set_ratio():
    assert token_set_ratio("A B C", "C B A") == 1.0 and token_set_ratio("A B", "A B C D") == 1.0
    assert token_set_ratio("", "A") == 0.0 and token_set_ratio("ABC", "XYZ") == 0.0
    assert 0.9 < token_set_ratio("POS SWIGGY BANGALORE", "POS SWIGGI BANGALORE") < 1


def test_cascade_prefers_rules_and_leaves_settled_rows(spark):
    columns = "tenant_id long, txn_id string, merchant string, amount decimal(18,2), category string, is_verified boolean, category_source string"
    rows = [(1, "a", "Shop", D(5), None, False, "x"), (1, "b", "Cafe", D(5), "misc", False, "fallback_other"), (1, "c", "Shop", D(5), "set", False, "x"), (1, "d", "None", D(5), None, False, "x")]
    rows += [(1, f"v{i}", "Cafe", D(5), "food", True, "x") for i in range(3)] + [(1, f"w{i}", "None", D(5), "y", True, "x") for i in range(2)]
    rules = spark.createDataFrame([(1, 1, "exact", "shop", None, 10, 1, 1, "ruled", True)], "tenant_id long, rule_id int, match_type string, pattern string, min_amount int, max_amount int, priority int, created_seq int, category string, is_active boolean")
    got = {r.txn_id: (r.category, r.tier) for r in C.cascade(spark.createDataFrame(rows, columns), rules).collect()}
    assert got == {"a": ("ruled", "user_rule"), "b": ("food", "historical_pattern"), "d": (None, "open")}


ROWS = "fixture string, row long, txn_date date, amount decimal(18,2), direction string, description string, merchant string, category string"


def test_scorecard_falls_with_every_kind_of_error(spark):
    truth = [("f", i, date(2024, 3, i + 1), D(100 + i), "debit", f"POS SHOP {i}", "Shop", "c") for i in range(10)]

    def card(read):
        return C.scorecard(spark.createDataFrame(truth, ROWS), spark.createDataFrame(read, ROWS)).where("fixture is null").first()

    assert (card(truth).recall, card(truth).precision, card(truth).amount_rate) == (D("1.00000"),) * 3
    assert card(truth[1:]).recall == D("0.90000")
    extra = ("f", 99, date(2024, 8, 1), D(7), "credit", "UNRELATED WORDS", None, None)
    assert card([*truth, extra]).precision == D("0.90909")
    flipped = [(*truth[0][:4], "credit", *truth[0][5:]), *truth[1:]]
    assert (card(flipped).recall, card(flipped).direction_rate) == (D("1.00000"), D("0.90000"))


PAGES = "doc_id int, pages array<struct<page_number:int,text:string>>"


def test_statement_text_rows(spark):
    first = "ACME BANK\nStatement period 01/03/2024 to 31/03/2024\nAccount No: XXXXXX1234\n01/03/2024 B/F 1,000.00\n02/03/2024 POS SHOP 100.00 900.00\ncontinued here"
    second = "03/03/2024 SALARY 500.00 1,400.00\nTotal 600.00\n04/03/2024 ODD ROW 50.00 1,300.00"
    docs = spark.createDataFrame([(1, [(1, first), (2, second)])], PAGES)
    opening = spark.createDataFrame([(1, D("1000.00"))], "doc_id int, opening_balance decimal(18,2)")
    got = X.text_rows(docs, opening).orderBy("source_row").collect()
    assert [(str(r.txn_date), r.description, r.amount, r.direction, r.direction_confidence, r.source_page) for r in got] == [
        ("2024-03-02", "POS SHOP continued here", D("100.00"), "debit", 0.99, 1),
        ("2024-03-03", "SALARY", D("500.00"), "credit", 0.99, 2),
        ("2024-03-04", "ODD ROW", D("50.00"), "debit", 0.5, 2),
    ]
    meta = docs.select(X.metadata(F.col("pages")[0]["text"]).alias("m")).first().m
    assert (str(meta.period_start), str(meta.period_end), meta.last4) == ("2024-03-01", "2024-03-31", "1234")


ACCOUNTS = (7, 40, 41, 200, 201, 12_345)


@pytest.fixture(scope="module")
def orders_dir(spark, tmp_path_factory):
    """Three orders of each account, two of them in one year."""
    folder = f"file://{tmp_path_factory.mktemp('orders')}"
    orders = [(10 * k + n, a, date(1996 + n // 2, 3 + n, 5), D(f"{1000 + 10 * k + n}.25"), "F", "1-URGENT") for k, a in enumerate(ACCOUNTS) for n in range(3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice decimal(15,2), o_orderstatus string, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(a, 1, "X") for a in ACCOUNTS], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    return folder


def test_scorecard_query_covers_every_account(spark, orders_dir):
    got = {r.fixture: r.expected for r in QUERIES["A32_J20_scorecard"](spark, orders_dir).collect()}
    assert got == {str(a): 3 for a in ACCOUNTS} | {None: 3 * len(ACCOUNTS)}


def test_statement_query_reads_back_every_account(spark, orders_dir):
    got = QUERIES["S7_S8_S11_S12_S14_statement_text"](spark, orders_dir).collect()
    want = S.statement_lines(spark, orders_dir).collect()
    assert sorted((r.doc_id, r.source_row, r.txn_date, r.amount, r.direction, r.direction_confidence) for r in got) == sorted((r.statement_id, r.source_row, r.txn_date, r.amount, r.direction, 0.99) for r in want)
    dates = {}
    for r in want:
        dates.setdefault(r.statement_id, []).append(r.txn_date)
    for r in got:
        account = r.doc_id // 10_000
        assert (r.parser, r.parser_score) == (("even", 1.0) if account % 2 == 0 else ("generic", 0.8))
        assert (r.masthead_lines, r.last4, r.opening_balance) == (5, f"{account % 10_000:04}", 0)
        assert (r.period_start, r.period_end) == (min(dates[r.doc_id]), max(dates[r.doc_id]))


def test_headers_and_dispatch(spark):
    row = spark.createDataFrame([(["Txn Date", "Narration", "Withdrawal Amt (INR)", "Deposit Amt", "Balance", "Date"],)], "cells array<string>")
    roles = X.header_roles(F.col("cells"))
    assert row.select(roles).first()[0] == ["date", "description", "debit", "credit", "balance", None] and row.select(X.usable(roles)).first()[0]
    docs = spark.createDataFrame([(1, [(1, "Acme Bank\nBranch ACME0001234\nx")]), (2, [(1, "nobody")])], PAGES)
    parsers = spark.createDataFrame([("acme", ["acme bank"], "ACME", 10), ("generic", ["zzz"], "ZZZZ", 0)], "code string, signatures array<string>, ifsc_prefix string, priority int")
    assert {r.doc_id: (r.code, r.score) for r in X.dispatch(docs, parsers).collect()} == {1: ("acme", 1.0), 2: ("generic", 0.0)}


def test_statement_json_keeps_money_exact(spark, tmp_path):
    held = {"fixture": "x", "metadata": {"opening_balance": "0.10", "period_start": "2024-03-01"}, "transactions": [{"txn_date": "2024-03-02", "amount": "12345678901234.56", "direction": "debit"}]}
    (tmp_path / "x.json").write_text(json.dumps(held))
    row = J.statement_rows(J.read_statements(spark, str(tmp_path))).first()
    assert (row.amount, str(row.txn_date), row.source_row) == (D("12345678901234.56"), "2024-03-02", 0)


def test_exports_refuse_to_cut_and_write_exact_text(spark, tmp_path):
    rows = ledger(spark, [spend("b", "2024-03-02", "1.10"), spend("a", "2024-03-01", "2.00")])
    with pytest.raises(ValueError, match="1 rows"):
        J.gather_export(rows, 1)
    J.export_csv(rows.select("txn_date", "txn_id", "amount", "is_expense"), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert text == b"txn_date,txn_id,amount,is_expense\r\n2024-03-01,a,2.00,yes\r\n2024-03-02,b,1.10,yes\r\n"
    J.export_json(rows.select("txn_date", "txn_id", "amount"), str(tmp_path / "json"))
    assert '"amount":"2.00"' in next((tmp_path / "json").glob("*.json")).read_text()


@pytest.mark.parametrize(("text", "kind", "score"), [("Credit Card: total amount due", "credit_card_statement", 1.0), ("savings account credit card", "unknown", 0.5), ("hello", "unknown", 0.0)])
def test_document_classes(spark, text, kind, score):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(*J.classify_document(F.col("t"))).first()) == (kind, score)


def test_job_progress_stream(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 10, m)
    events = spark.createDataFrame([("j", 1, at(0), "running"), ("j", 1, at(0), "running"), ("j", 2, at(1), "completed"), ("k", 1, at(1), "running")], "job_id string, seq int, occurred_at timestamp, state string")
    events.write.parquet(str(tmp_path / "in"))
    stream = T.job_progress(T.event_stream(spark, str(tmp_path / "in"), events.schema))
    run = stream.writeStream.format("memory").queryName("progress").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r.job_id, r.seq, r.state, r.closed) for r in spark.table("progress").collect()} == {("j", 2, "completed", True), ("k", 1, "running", False)}


def test_rate_windows_and_notices(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 10, 0, s), 1) for s in range(6)], "ts timestamp, user_id int")
    assert {r.n for r in T.rate_windows(rows, "user_id", limit=5).collect()} == {6}
    notices = spark.createDataFrame([("a", None), ("a", None), ("a", "r")], "kind string, resource string")
    assert T.one_time_notices(notices).count() == 2
    said = spark.createDataFrame([(True, False, 1), (False, False, 1), (False, True, 1), (False, True, 0)], "f boolean, r boolean, n int")
    got = [x[0] for x in said.select(T.statement_notice(F.col("f"), F.col("r"), F.col("n"))).collect()]
    assert got == ["statement_failed", "statement_unreconciled", "review_required", "statement_processed"]


def test_rebuild_runs_once_for_what_has_arrived(spark, tmp_path):
    rows = spark.range(3)
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        T.rebuild_on_import(T.event_stream(spark, str(tmp_path / "in"), rows.schema), lambda b: seen.append(b.count()), str(tmp_path / "c")).awaitTermination()
    assert seen == [3]
