"""Findings of the third round: each test failed before its finding was mended."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import narration as T
from ledgerloom.functions import privacy as V
from ledgerloom.functions import safety as D
from ledgerloom.queries import QUERIES
from ledgerloom.sources import adapters as S
from ledgerloom.streaming import stateful as K
from ledgerloom.streaming import tables as W


def test_f1_jobs_share_the_calls_of_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BUCKETS", 3)
    schema, out, log = "job_id long, seq long, occurred_at timestamp, state string", str(tmp_path / "out"), str(tmp_path / "log")
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    history = spark.createDataFrame([(j, 0, at(0), "failed" if j % 5 == 0 else "queued") for j in range(1, 41)], schema)

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        return W.run_to_end(K.followed_jobs(stream, history, timeout_ms=3_600_000, delay="10 minutes"), out, log)

    arrive(*[(j, s, at(2 * s), "completed" if j % 4 == 0 and s == 2 else "queued") for j in range(1, 81) for s in (1, 2, 3)])
    arrive((200, 1, at(100), "queued"), (2, 4, at(50), "queued"))  # the watermark comes to 90: all but jobs 2 and 200 are an hour old
    rows = arrive((200, 2, at(101), "queued")).collect()
    assert len(rows) == len({(r.job_id, r.seq, r.kind) for r in rows})
    shown = {(r.job_id, r.seq) for r in rows if r.kind == "event"}
    over = lambda j: j <= 40 and j % 5 == 0
    assert shown == {(j, s) for j in range(1, 81) for s in (1, 2, 3) if not over(j) and not (j % 4 == 0 and s == 3)} | {(2, 4), (200, 1), (200, 2)}
    assert {r.job_id for r in rows if r.kind == "done"} == {j for j in range(4, 81, 4) if not over(j)}
    assert {(r.job_id, r.occurred_at) for r in rows if r.kind == "timeout"} == {(j, at(6)) for j in range(1, 81) if not over(j) and j % 4 and j != 2}
    assert K.followed_jobs(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).schema.names == ["job_id", "seq", "occurred_at", "state", "kind"]


def test_f2_exports_of_a_query_have_no_cap(spark, tmp_path):
    rows = spark.range(50_001).select(F.col("id").alias("o_orderkey"), F.lit(datetime(1995, 3, 15)).alias("o_orderdate"), F.lit(1.5).alias("o_totalprice"), F.lit("F").alias("o_orderstatus"))
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("S22_S24_json_export", "S21_O6_csv_export"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 50_001


@pytest.mark.parametrize(
    "text, reason",
    [
        ("\u00f3os.", "data_exfiltration"), ("caf\u00e9\u00e9token", "data_exfiltration"), ("pa\u017f\u017fword", "data_exfiltration"), ("my tokens", None),
        ("user\u00a0:", None), ("select \u2028 x from", "data_exfiltration"), ("act\nas", "behaviour_directive"),
    ],
)
def test_f3_patterns_have_the_ends_of_words_of_their_sql(spark, text, reason):
    got = spark.createDataFrame([(text,)], "text string").select(D.injection_reason(F.col("text"))).first()[0]
    assert got == reason


def _events(spark, tmp_path, times):
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "event_id long, user_id long, ts timestamp_ntz")
    rows.write.parquet(str(tmp_path / "events.parquet"))


def test_f4_windows_take_times_to_the_nearest_second(spark, tmp_path):
    _events(spark, tmp_path, [datetime(2024, 1, 1, 23, 59, 59, 600_000)] * 11)
    since = {r.since for r in QUERIES["T2_rate_windows"](spark, str(tmp_path)).collect()}
    assert since == {datetime(2024, 1, 2) - timedelta(days=k) for k in range(7)}


def test_f5_sliding_counts_take_times_to_the_nearest_second(spark, tmp_path):
    _events(spark, tmp_path, [datetime(2024, 1, 1, 10, 0, 0, 600_000), datetime(2024, 1, 1, 11, 0, 1, 400_000), datetime(2024, 1, 1, 12, 0, 1, 500_000)])
    assert {(r.event_id, r.n) for r in QUERIES["W10_sliding_rate"](spark, str(tmp_path)).collect()} == {(0, 1), (1, 2), (2, 1)}


SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f6_f7_rows_meet_their_aliases_over_one_exchange(spark):
    rows = spark.createDataFrame([(1, "POS ACME STORES 1"), (2, "UPI-x@ok"), (3, "UPI-acme@ok")], "k int, description string")
    aliases = spark.createDataFrame([("Acme", "a", "Acme"), ("Acme Stores", "s", "Acme Stores")], "alias string, slug string, name string")
    named = T.normalize_merchants(rows, aliases, "k")
    assert "row_number" not in _plan(named)
    assert {(r.k, r.slug, r.merchant_confidence) for r in named.where("k <> 2").collect()} == {(1, "s", 0.99), (3, "a", 0.99)}


def test_f8_f10_a_sweep_reads_its_ledger_once(spark):
    for name in ("A13_anomaly_sweep", "Q7_get_anomalies"):
        assert all("/swept-" in f for f in QUERIES[name](spark, SMALL).inputFiles())


def test_f11_f14_equal_answers_are_scanned_once(monkeypatch):
    seen = []
    monkeypatch.setattr(V, "spans_of", lambda t: seen.append(t) or [])
    assert [V._kind_of("an answer 17") for _ in range(3)] == [None] * 3 and seen == ["an answer 17"]


def test_f12_line_items_are_numbered_where_their_orders_are(spark):
    assert "hashpartitioning(l_orderkey#" in (plan := _plan(S.lineitem_ledger(spark, SMALL)).replace("\n", " ")) and "l_linenumber#" in plan
    assert not re.search(r"hashpartitioning\(l_orderkey#\d+L?, l_linenumber", plan)
