"""Audit entries, dimensions, log records and periods on literal rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerloom.functions import safety as D
from ledgerloom.operators import reads
from ledgerloom.operators import records as P

ACTIONS = "tenant_id long, user_agent string, succeeded boolean, details map<string,string>"


def test_audit_entries_keep_allowed_details_and_requests_count_once(spark, tmp_path):
    rows = [(1, "x" * 300, None, {"count": "3", "merchant": "Asha"}), (2, "", False, {}), (3, None, True, None), (4, "a", True, {"iban": "x"})]
    entries = P.audit_entries(spark.createDataFrame(rows, ACTIONS), ["count"])
    got = {r.tenant_id: (r.user_agent, r.succeeded, r.details and json.loads(r.details)) for r in entries.collect()}
    assert got == {1: ("x" * 255, True, {"count": "3", "dropped_fields": "merchant"}), 2: (None, False, None), 3: (None, True, None), 4: ("a", True, {"dropped_fields": "iban"})}
    path = str(tmp_path / "audit")
    for request in ("r1", "r2", "r1"):
        P.append_once(entries, path, request)
    assert spark.read.parquet(path).groupBy("request_id").count().orderBy("request_id").collect() == [("r1", 4), ("r2", 4)]


def test_corrections_leave_an_entry_for_each_field_that_they_change(spark):
    fields = "merchant string, category string, movement_type string, is_expense boolean, direction string, amount decimal(18,2)"
    ledger = spark.createDataFrame([(1, "a", "m", "food", "expense", True, "debit", None), (1, "b", None, None, "expense", True, "debit", None)], f"tenant_id long, txn_id string, {fields}")
    fixes = [(1, "a", 1, None, "rent", None, None, None, None), (1, "a", 2, None, "rent", None, False, None, None), (1, "a", 3, "n", "food", None, None, None, None), (1, "b", 1, "m", None, None, True, None, None)]
    got = P.correction_entries(ledger, spark.createDataFrame(fixes, f"tenant_id long, txn_id string, seq int, {fields}")).collect()
    assert sorted(tuple(r)[1:] for r in got) == [
        ("a", 1, "category", "food", "rent"), ("a", 2, "is_expense", "true", "false"), ("a", 3, "category", "rent", "food"), ("a", 3, "merchant", "m", "n"), ("b", 1, "merchant", None, "m"),
    ]


def test_a_second_seeding_changes_nothing_and_keeps_ids(spark):
    schema = "slug string, name string, aliases array<string>"
    seeds = spark.createDataFrame([("b", "B", ["bee", " Bee "]), ("a", "A", ["x" * 250]), ("b", "B", ["bee", " Bee "])], schema)
    empty = seeds.limit(0).withColumn("id", F.lit(None).cast("string"))
    other = spark.createDataFrame([("b", "old", ["q"]), ("z", "Z", [""])], schema)
    first = P.merged_dimension(empty, other, "merchant", ["slug"])
    once = P.merged_dimension(first, seeds, "merchant", ["slug"])
    twice = P.merged_dimension(once, seeds, "merchant", ["slug"])
    rows = sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, twice.collect())) == rows and [r[:2] for r in rows] == [("a", "A"), ("b", "B"), ("z", "Z")]
    ids = {r.slug: r.id for r in first.collect()}
    assert all(r.id == ids.get(r.slug, r.id) for r in once.collect())
    assert spark.range(1).select(reads.url_key(F.lit("merchant/a"))).first()[0] == next(r.id for r in once.collect() if r.slug == "a")
    assert sorted((r.pattern, r.priority) for r in P.alias_rows(once).collect()) == [("BEE", 197), ("X" * 250, 1)]


def test_log_records_are_scrubbed_at_any_depth(spark):
    record = {"request_id": "9876543210123", "event": "paid ₹500 to ABCDE1234F", "merchant": "Asha", "exception": {"args": ["ABCDE1234F", 1, None, {"x": "ABCDE1234F"}]}}
    rows = spark.createDataFrame([(json.dumps(record),), ("[1]",), ("no json",), (None,)], "r string")
    got = [r[0] for r in rows.select(D.log_record(["request_id", "event", "exception"], ["request_id"])("r")).collect()]
    assert got[1:] == [None] * 3
    clean = json.loads(got[0])
    assert clean["request_id"] == "9876543210123" and clean["dropped_fields"] == ["merchant"]
    assert "ABCDE1234F" not in got[0] and "500" not in clean["event"] and clean["exception"]["args"][1:3] == [1, None]


def test_periods_are_months_or_years(spark):
    rows = spark.createDataFrame([(x,) for x in ("2024-02", "1990", "2100-12", "1989", "2101", "2024-13", "2024-1", "", None, "2024-02-01")], "t string")
    first, last = P.period_of(F.col("t"))
    got = {r.t: (str(r.a), str(r.b)) for r in rows.select("t", first.alias("a"), last.alias("b")).collect() if r.a}
    assert got == {"2024-02": ("2024-02-01", "2024-02-29"), "1990": ("1990-01-01", "1990-12-31"), "2100-12": ("2100-12-01", "2100-12-31")}
