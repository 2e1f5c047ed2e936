"""Records of calls, narratives, imports in numbers and swept objects on literal rows."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import perimeter as P
from ledgerloom.operators import reads, trust
from ledgerloom.operators import storage as B

AT = datetime(2024, 1, 28, 10)
CALL = "call_id long, tenant_id long, txn_id string, at timestamp, model_name string, model_version string, payload map<string,string>, answer string, error_code string, input_tokens long, output_tokens long, latency_ms int"
ANSWER = "tenant_id long, month string, at timestamp, view map<string,string>, text string, tool_calls int, error_code string, model_name string"


def _call(n, answer, error=None, payload=None, tokens=(1_000_000, 0)):
    return (n, 1, None, AT, "m", None, payload or {}, answer, error, *tokens, 5)


def test_calls_are_recorded_by_names_and_hash(spark):
    food = '{"category": "food", "confidence": 0.5}'
    calls = [
        _call(1, food, payload={"merchant": "Shop", "direction": "debit", "mcc_hint": None}),
        _call(2, food, "timeout"), _call(3, None), _call(4, '{"category": "food", "reasoning": "mail a.b@example.org"}'),
        _call(5, '{"category": "rent", "confidence": 1}', tokens=(None, None)), _call(1, food),
    ]
    judged = P.judged_calls(spark.createDataFrame(calls, CALL))
    records = P.call_records(judged, spark.createDataFrame([("food", 7)], "slug string, category_id int"), "none", "250", "1000")
    rows = sorted(records.collect(), key=lambda r: (r.call_id, r.fields_sent))
    assert [(r.call_id, r.outcome, r.error_code, r.predicted_category_id, r.accepted) for r in rows] == [
        (1, "ok", None, 7, True), (1, "ok", None, 7, True), (2, "provider_error", "timeout", None, False), (3, "output_rejected", "not_an_object", None, False),
        (4, "output_rejected", "pii_echo", None, False), (5, "ok", None, None, True),
    ]
    full = next(r for r in rows if "merchant" in r.fields_sent)
    payload = json.dumps({"direction": "debit", "merchant": "Shop"}, separators=(",", ":"))
    assert json.loads(full.fields_sent) == ["direction", "merchant"] and full.payload_hash == hashlib.sha256(payload.encode()).hexdigest()
    assert [str(r.cost) for r in rows][-1] == "0.000000" and str(full.cost) == "250.000000" and "Shop" not in str(full)
    fired = [(r.kind, r.detector, json.loads(r.context)["stage"]) for r in P.incident_records(judged, "categorize").orderBy("kind").collect()]
    assert fired == [("output_pii_echo", "EMAIL", "categorize"), ("output_schema_violation", "not_an_object", "categorize")]
    day = P.usage_by_day(records).first()
    assert (day.calls, day.accepted, day.outputs_rejected, day.input_tokens) == (6, 3, 2, 5_000_000)
    assert P.call_records(judged.limit(0), spark.createDataFrame([], "slug string, category_id int"), "none", "1", "1").count() == 0


def test_narratives_pass_only_with_figures_of_their_view(spark, tmp_path):
    view = {"spending_rupees": "1234567", "savings_percent": "-12", "transaction_count": "40", "note": None}
    texts = {
        "2024-01": ("You spent ₹12,34,567 over 40 payments, 12% of it saved.", 0, None, view, "ok", None, None),
        "2024-02": ("You spent ₹40.", 0, None, view, "untraceable_figure", None, "currency"),
        "2024-03": ("fine", 1, None, view, "output_rejected", "unexpected_tool_call", None),
        "2024-04": ("mail a.b@example.org", None, None, view, "output_rejected", "pii_echo", "EMAIL"),
        "2024-05": (None, None, None, view, "output_rejected", "not_text", None),
        "2024-06": ("fine", 0, "timeout", view, "provider_error", None, None),
        "2024-07": ("fine", 0, None, view | {"note": "a.b@example.org"}, "pii_in_payload", None, "EMAIL"),
        "2024-08": ("Saved twelve, and ₹5.", 0, None, None, "untraceable_figure", None, "currency,word_number"),
    }
    rows = [(1, month, AT, t[3], t[0], t[1], t[2], "m") for month, t in texts.items()]
    judged = P.judged_narratives(spark.createDataFrame(rows, ANSWER))
    assert {r.month: (r.outcome, r.rejected_by, r.detector) for r in judged.collect()} == {m: t[4:] for m, t in texts.items()}
    kinds = [r.kind for r in P.incident_records(judged, "narrative").orderBy("kind").collect()]
    assert kinds == ["output_pii_echo", "output_schema_violation", "output_untraceable_figure", "output_untraceable_figure", "pii_in_payload"]

    path, snapshots = str(tmp_path / "n"), judged.select("tenant_id", "month")
    later = judged.withColumns({"at": F.col("at") + F.expr("interval 1 day"), "narrative": F.when(F.col("narrative").isNotNull(), "Later.")})
    for part, request in ((later, "b"), (judged, "a"), (later, "b")):
        P.store_narratives(part, snapshots, path, request)
    P.store_narratives(judged, snapshots.where("month > '2024-01'"), path, "c")
    stored = spark.read.schema(P.NARRATIVES).parquet(path)
    assert stored.count() == 2 and [tuple(r) for r in P.stored_narratives(stored).collect()] == [(1, "2024-01", "Later.", "m", "2024-01-29T10:00:00")]


def test_figures_that_are_not_numbers_are_scanned(spark):
    rows = [(1, "2024-01", AT, {"spending_rupees": "call 9876543210"}, "fine", 0, None, "m"), (1, "2024-02", AT, {"account": "123456789012"}, "fine", 0, None, "m")]
    assert {r.outcome for r in P.judged_narratives(spark.createDataFrame(rows, ANSWER)).collect()} == {"pii_in_payload"}


def test_imports_in_numbers_and_words(spark):
    imports = spark.createDataFrame([(1, "A", 3, "0.00", "trusted"), (2, "A", None, "-0.01", "untrusted"), (3, "B", 1, None, "pending"), (4, "B", 1, "100.01", "untrusted")], "statement_id long, bank string, page_count int, d string, trust_status string")
    imports = imports.withColumn("delta", F.col("d").cast("decimal(18,2)"))
    rows = spark.createDataFrame([(1, "flagged", "rule"), (1, "flagged", None), (3, "auto_approved", "rule"), (9, "flagged", "rule")], "statement_id long, review_status string, category_source string")
    got = {tuple(r)[:3]: r.n for r in P.import_metrics(imports, rows).collect()}
    assert got == {
        ("pages_processed", "A", "text"): 3, ("pages_processed", "B", "text"): 2, ("reconciliation_delta_paise", "A", "0"): 1, ("reconciliation_delta_paise", "A", "1"): 1,
        ("reconciliation_delta_paise", "B", "over"): 1, ("validation_failures", "A", "reconciliation"): 1, ("validation_failures", "B", "reconciliation"): 2,
        ("transactions_ingested", "A", "flagged"): 2, ("transactions_ingested", "B", "auto_approved"): 1, ("categorization", "A", "rule"): 1, ("categorization", "B", "rule"): 1,
    }
    words = spark.createDataFrame([(0, 4, "trusted"), (0, 0, None), (2, 1, "trusted"), (2, 0, "untrusted")], "i int, d int, t string")
    said = [r[0] for r in words.select(P.import_message(F.col("i"), F.col("d"), F.col("t"))).collect()]
    assert said[0].startswith("Already imported — 4") and said[1].endswith("could not be checked") and said[2].startswith("2 ") and said[3].endswith("does not reconcile")


def test_a_sweep_knows_the_objects_of_what_it_removed_also_when_run_again(spark, tmp_path):
    rows = [(1, "1/a", "2020-01-01", 2020), (1, None, "2020-01-01", 2020), (2, "2/b", None, 2020), (2, "2/c", "2024-01-30", 2024), (None, "x", "2019-01-01", None)]
    frame = spark.createDataFrame(rows, "tenant_id long, storage_key string, deleted_at string, year int")
    table = B.StoredTable.write(frame, f"file://{tmp_path}/s", "year")
    for _ in range(2):
        counts, keys = B.sweep_with_objects(spark, {"statements": (table, "deleted_at", 30)}, "statements", "2024-01-31", f"file://{tmp_path}/log")
        assert [tuple(r) for r in counts.collect()] == [("statements", 3)]
        assert sorted(r.storage_key for r in keys.collect()) == ["1/a", "x"]
    assert sorted(r.storage_key for r in B.storage_keys(table.read(spark), 2).collect()) == ["2/b", "2/c"]


def test_a_balance_that_moved_by_another_amount_halves_the_confidence(spark):
    rows = [(1, 1, "5.00", None), (1, 2, "5.00", "10.00"), (1, 3, "2.00", None), (1, 4, "3.00", "7.00"), (1, 5, "3.00", "5.00"), (2, 1, "9.00", "1.00")]
    lines = spark.createDataFrame(rows, "statement_id long, source_row int, a string, b string").selectExpr("statement_id", "source_row", "cast(a as decimal(18,2)) amount", "cast(b as decimal(18,2)) balance_after")
    got = {(r.statement_id, r.source_row): (str(r.amount_confidence), str(r.direction_confidence), r.warning) for r in trust.balance_movement(lines).collect()}
    assert [k for k, v in got.items() if v == ("0.50", "0.50", "balance_movement_mismatch")] == [(1, 5)]
    assert all(v == ("0.90", "0.90", None) for k, v in got.items() if k != (1, 5))


def test_listed_statements_have_their_newest_job(spark):
    statements = spark.createDataFrame([(1, 7, None), (2, 8, None), (3, 7, "2024-01-01")], "statement_id long, account_id long, deleted_at string")
    accounts = spark.createDataFrame([(7, "Bank", "savings")], "account_id long, bank_name string, account_type string")
    extracted = spark.createDataFrame([(1, 4)], "statement_id long, extracted_count long")
    jobs = spark.createDataFrame([(10, 1, 5, "queued", 0), (11, 1, 5, "failed", 9), (12, 1, 4, "completed", 100), (13, None, 9, "queued", 0)], "job_id long, statement_id long, created_at long, state string, progress int")
    rows = {r.statement_id: (r.bank_name, r.extracted_count, r.job_id, r.job_state, r.progress) for r in reads.statement_list(statements, accounts, extracted, jobs).collect()}
    assert rows == {1: ("Bank", 4, 11, "failed", 9), 2: (None, 0, None, None, None)}
