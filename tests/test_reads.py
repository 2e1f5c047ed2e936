"""Rules of tenants, learning, table readers, the perimeter around models, and reads."""

from __future__ import annotations

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import narration as T
from ledgerloom.functions import privacy as V
from ledgerloom.operators import categorize as C
from ledgerloom.operators import reads as P
from ledgerloom.plans import tools as Q
from ledgerloom.queries import reads as queries
from ledgerloom.sources import statement_tables as B

RULES = "tenant_id long, rule_id int, match_type string, pattern string, min_amount int, max_amount int, priority int, created_seq int, category string, is_active boolean"
ROWS = "tenant_id long, txn_id string, merchant string, amount decimal(18,2), category string, is_verified boolean, category_source string"


def test_one_tenants_rules_leave_the_others_alone(spark):
    rows = spark.createDataFrame([(t, "a", "Shop", D(5), None, False, "x") for t in (1, 2, 3)], ROWS)
    rules = spark.createDataFrame([(1, 1, "exact", "shop", None, None, 1, 1, "mine", True), (3, 1, "contains", "s_o", None, None, 1, 1, "wild", True)], RULES)
    got = {r.tenant_id: (r.category, r.tier) for r in C.cascade(rows, rules).collect()}
    assert got == {1: ("mine", "user_rule"), 2: (None, "open"), 3: ("wild", "user_rule")}


def test_corrections_become_rules_of_their_tenant(spark):
    rules = spark.createDataFrame([(1, 7, "exact", "Shop", None, None, 3, 1, "old", False), (2, 8, "exact", "Shop", None, None, 3, 1, "kept", True)], RULES)
    corrections = spark.createDataFrame([(1, 1, "SHOP", "first"), (1, 2, "shop", "last"), (1, 3, "Cafe", "food"), (1, 4, None, "x")], "tenant_id long, seq int, merchant string, category string")
    got = {(r.tenant_id, r.pattern): (r.category, r.is_active, r.priority) for r in C.learned_rules(rules, corrections).collect()}
    assert got == {(1, "Shop"): ("last", True, 3), (2, "Shop"): ("kept", True, 3), (1, "Cafe"): ("food", True, 10)}
    assert C.learned_rules(rules, corrections.limit(0)).count() == 2
    changed = rules.where("tenant_id = 1").withColumn("category", F.lit("new"))
    assert {r.category for r in C.saved_rules(rules, changed).collect()} == {"new", "kept"}
    assert C.without_rules(rules, changed).count() == 1


CELLS = "doc_id int, page_number int, table_no int, row_no int, cells array<string>"


def _table(spark, rows):
    return spark.createDataFrame([(1, p, t, k, c) for k, (p, t, c) in enumerate(rows)], CELLS)


def test_headers_carry_over_pages_and_rows_continue(spark):
    head = ["Txn Date", "Narration", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"]
    rows = [
        (1, 0, ["junk", None, "", "", ""]), (1, 0, head), (1, 0, ["", "B/F", "", "", "100.00"]), (1, 0, ["01/03/2024", "POS SHOP", "10.00", "", "90.00"]),
        (2, 0, ["", "MORE OF IT", "", "", ""]), (2, 0, ["02/03/2024", "SALARY", "", "1,000.00", "1,090.00"]), (2, 0, ["99/99/2024", "BAD", "1.00", "", ""]),
        (2, 0, ["", "Grand Total", "11.00", "", ""]), (2, 0, ["", "", "", "", ""]),
    ]
    got = B.table_rows(_table(spark, rows)).orderBy("source_page", "source_row").collect()
    assert [(r.txn_date, r.description, r.amount, r.direction, r.balance_after, r.source_page) for r in got] == [
        (date(2024, 3, 1), "POS SHOP MORE OF IT", D("10.00"), "debit", D("90.00"), 1), (date(2024, 3, 2), "SALARY", D("1000.00"), "credit", D("1090.00"), 2),
    ]
    assert B.table_rows(_table(spark, [(1, 0, ["01/03/2024", "X", "1.00"])])).count() == 0  # no header at all


def test_one_amount_column_goes_by_mark_balance_or_card(spark):
    head = ["Date", "Description", "Amount", "Balance"]
    rows = [(1, 0, head), (1, 0, ["01/03/2024", "A", "10.00 Dr", "90.00"]), (1, 0, ["02/03/2024", "B", "5.00", "95.00"]), (1, 0, ["03/03/2024", "C", "5.00", ""])]
    got = {r.description: r.direction for r in B.table_rows(_table(spark, rows)).collect()}
    assert got == {"A": "debit", "B": "credit"}  # nothing tells the last one's direction
    card = {r.description: (r.direction, r.balance_after) for r in B.table_rows(_table(spark, rows), card=True).collect()}
    assert card == {x: ("debit", None) for x in "ABC"}


def test_payloads_fail_closed(spark):
    made = spark.createDataFrame([("Swiggy", True, "card"), ("ABCDE1234F", True, "card"), ("Asha", False, "imps"), ("X" * 81, True, "card")], "m string, k boolean, r string")
    built = V.payload(F.col("m"), F.col("k"), F.lit("x"), F.lit(250), F.lit("debit"), F.col("r"), F.lit(None).cast("string"), F.lit("2024-03-03").cast("date"))
    sent, by, field = V.checked_payload(F.col("p"))
    got = [tuple(r) for r in made.select(built.alias("p")).select(F.col("p").isNotNull(), sent.isNotNull().alias("s"), by.alias("b"), field.alias("f")).collect()]
    assert [g[1] for g in got] == [True, False, False, False]
    assert [g[2] for g in got] == [None, "PAN", "no_sendable_merchant", "schema_violation"] and got[1][3] == "merchant"


def test_answers_and_prose_are_checked(spark):
    rows = spark.createDataFrame([(a, by) for a, by, _, _ in queries.ANSWERS] + [("", "not_an_object"), (None, "not_an_object")], "a string, want string")
    for r in rows.select("a", "want", V.prediction(F.col("a")).alias("p")).collect():
        assert r.p.rejected_by == r.want, r.a
    rows = spark.createDataFrame(list(queries.PROSE), "t string, want string")
    assert all(r.by == r.want for r in rows.select("want", V.rejected_prose(F.col("t"))[0].alias("by")).collect())


def test_fuzzy_names(spark):
    names = spark.createDataFrame([("CORNER BAKERIE PUNE",), ("ZEPHYR",), ("",)], "hay string")
    aliases = spark.createDataFrame([("CORNER BAKERY PUNE", "bakery"), ("ZEPTO", "zepto")], "alias string, slug string")
    assert {r.hay: r.slug for r in T.fuzzy_matches(names, aliases).collect()} == {"CORNER BAKERIE PUNE": "bakery"}


def test_monthly_keys_are_name_based_identifiers(spark):
    import uuid

    got = spark.range(3).select("id", P.monthly_key("budget", F.col("id"), F.lit("2024-03-15").cast("date")).alias("k")).collect()
    assert all(r.k == str(uuid.uuid5(uuid.NAMESPACE_URL, f"budget/{r.id}/2024-03-01")) for r in got)


def test_suggestions_and_insights(spark):
    assert Q.suggested("month_change", date(2024, 1, 9)) == ("compare_months", {"left": "2023-12", "right": "2024-01"})
    assert Q.suggested("no such", date(2024, 1, 9)) is None
    for bad in ({"name": "no such"}, {"name": "daily", "months": 37}, {"name": "daily", "limit": 0}):
        with pytest.raises(ValueError):
            Q.insight(None, month=date(2024, 1, 1), **bad)
