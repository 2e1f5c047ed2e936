"""Streams with keyed state over several runs, stored tables that a stopped job left half done, and the ingestion source."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import recurring as R
from ledgerloom.operators import storage as B
from ledgerloom.sources import canonical_source as C
from ledgerloom.streaming import stateful as K
from ledgerloom.streaming import tables as W

EVENTS = "job_id long, seq long, occurred_at timestamp, state string"
T0 = datetime(2024, 1, 1)


def events(*rows):
    return [(job, seq, T0 + timedelta(minutes=minute), state) for job, seq, minute, state in rows]


def test_followed_jobs_show_nothing_twice_over_restarts_and_close(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    history = spark.createDataFrame(events((1, 1, 0, "queued"), (1, 2, 5, "extracting"), (2, 1, 0, "queued"), (2, 2, 1, "failed")), EVENTS)

    def arrive(*rows):
        spark.createDataFrame(events(*rows), EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        return W.run_to_end(K.followed_jobs(stream, history, timeout_ms=3_600_000, delay="20 minutes"), out, log)

    # An event of the history again, one after it, one of a job that is over, a new job.
    arrive((1, 2, 5, "extracting"), (1, 3, 6, "validating"), (2, 3, 9, "queued"), (3, 1, 2, "queued"))
    # The same again and more; job 1 ends, what comes later is not shown.
    arrive((1, 3, 6, "validating"), (1, 4, 7, "completed"), (1, 5, 8, "queued"), (3, 1, 2, "queued"))
    rows = arrive((1, 6, 9, "queued"), (4, 1, 600, "queued"))  # ten hours on: job 3 has been silent for an hour
    rows = arrive((4, 2, 601, "queued"))  # job 4 goes on, and its timer with it
    rows = arrive((5, 1, 670, "queued"))
    assert rows.where("job_id = 4 and kind = 'timeout'").count() == 0  # the watermark is at 650, the hour ends at 661
    rows = arrive((5, 2, 690, "completed"))
    got = sorted((r.job_id, r.kind, r.seq or 0, r.state or "") for r in rows.collect())
    assert got == [
        (1, "done", 4, "completed"), (1, "event", 3, "validating"), (1, "event", 4, "completed"), (3, "event", 1, "queued"), (3, "timeout", 0, ""),
        (4, "event", 1, "queued"), (4, "event", 2, "queued"), (4, "timeout", 0, ""), (5, "done", 2, "completed"), (5, "event", 1, "queued"), (5, "event", 2, "completed"),
    ]


def test_rate_decisions_equal_those_of_the_whole_log(spark, tmp_path):
    rng, schema = random.Random(3), "user_id long, event_id long, ts timestamp"
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    rows, at = [], T0
    for i in range(240):
        at += timedelta(seconds=rng.choice([0, 1, 5, 20, 60, 61]))
        rows.append((rng.randint(1, 3), i, at))
    for k in range(0, 240, 80):
        spark.createDataFrame(rows[k : k + 80], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        got = W.run_to_end(K.rate_decisions(stream, "user_id", 3, 60), out, log)
    want = []
    for k, (user, i, ts) in enumerate(rows):
        used = sum(u == user and ts - timedelta(seconds=60) < t <= ts for u, _, t in rows[: k + 1])
        want.append((i, used, used <= 3, max(3 - used, 0), 0 if used <= 3 else 60))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != W.ROCKS


LEDGER = "tenant_id long, txn_id string, account_id long, statement_id long, txn_date date, amount decimal(18,2), direction string, movement_type string, is_expense boolean, merchant string, category string, trust_status string, review_status string"


def ledger_rows(first, n):
    day = date(2024, 1, 5)
    return [(1 + i % 2, str(i), 1, 1, day + timedelta(i % 170), i + 1, "debit", "expense", True, "m", "c", "trusted", "approved") for i in range(first, first + n)]


def test_a_rebuild_that_runs_twice_leaves_the_same_tables(spark, tmp_path):
    ledger, made = str(tmp_path / "ledger"), str(tmp_path / "snapshots")
    build = W.rebuild_after_import(ledger, made, R.subscriptions, date(2024, 6, 20))
    first, second = (spark.createDataFrame([(*r[:5], __import__("decimal").Decimal(r[5]), *r[6:]) for r in ledger_rows(a, 170)], LEDGER) for a in (0, 170))
    build(first, 0)
    build(second, 1)
    once = sorted(map(str, spark.read.parquet(made).collect()))
    build(second, 1)
    assert sorted(map(str, spark.read.parquet(made).collect())) == once and len(once) == 6
    assert spark.read.parquet(ledger).count() == 340
    whole = W.snapshot(first.unionByName(second), R.subscriptions(first.unionByName(second), date(2024, 6, 20)), date(2024, 5, 1))
    stored = spark.read.parquet(made).where("period_month = '2024-05-01'")
    assert {(r.tenant_id, r.total_expenses, r.breakdown) for r in stored.collect()} == {(r.tenant_id, r.total_expenses, r.breakdown) for r in whole.collect()}


def stored(spark, path, n=90):
    rows = spark.range(n).select("id", (F.col("id") % 5).alias("tenant_id"), F.when(F.col("id") % 9 < 8, F.concat(F.lit("p"), (F.col("id") % 9).cast("string"))).alias("part"))
    return B.StoredTable.write(rows, str(path), "part")


def test_batched_deletion_touches_only_its_partitions_and_empties_some(spark, tmp_path):
    table, log = stored(spark, tmp_path / "t"), str(tmp_path / "log")
    before = {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "t").glob("part=*")}
    hit = B.where((F.col("part") == "p3") | (F.col("part").isNull() & (F.col("tenant_id") == 0)))
    assert B.delete_rows(spark, table, hit, log, "job", at_once=1) == 10 + 2
    left = table.read(spark)
    assert {r.id for r in left.collect()} == {i for i in range(90) if i % 9 != 3 and not (i % 9 == 8 and i % 5 == 0)}
    after = {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "t").glob("part=*")}
    assert "part=p3" not in after
    assert all(after[k] == before[k] for k in before if k not in ("part=p3", "part=__HIVE_DEFAULT_PARTITION__"))
    assert B.delete_rows(spark, table, hit, log, "job") == 12  # again: nothing more, the same count


@pytest.mark.parametrize("stop_before", [True, False])
def test_a_stopped_erasure_goes_on_with_its_counts(spark, tmp_path, monkeypatch, stop_before):
    table, log = stored(spark, tmp_path / "t"), str(tmp_path / "log")
    place, calls = B._put_in_place, []

    def stops(*args):
        calls.append(1)
        if len(calls) == 2:
            if not stop_before:
                place(*args)
            raise RuntimeError("stopped")
        place(*args)

    monkeypatch.setattr(B, "_put_in_place", stops)
    with pytest.raises(RuntimeError):
        B.erase_tenant(spark, {"t": table}, 3, log, at_once=2)
    assert table.read(spark).where("tenant_id = 3").count() > 0
    got = B.erase_tenant(spark, {"t": table}, 3, log, at_once=2).collect()
    assert [tuple(r) for r in got] == [("t", 18)]
    assert sorted(r.id for r in table.read(spark).collect()) == [i for i in range(90) if i % 5 != 3]


def test_soft_deletion_marks_once(spark, tmp_path):
    ledger = B.StoredTable.write(spark.range(20).select("id", (F.col("id") % 4).alias("statement_id"), (F.col("id") % 2).alias("y")), str(tmp_path / "l"), "y")
    rows = spark.range(4).select(F.col("id").alias("statement_id"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(1).alias("y"))
    statements = B.StoredTable.write(rows, str(tmp_path / "s"), "y")
    gone = spark.createDataFrame([(1,), (1,), (None,), (77,)], "statement_id long")
    assert B.soft_delete(spark, ledger, statements, gone, "2024-01-01 00:00:00", str(tmp_path / "log"), "a") == 5
    assert B.soft_delete(spark, ledger, statements, gone, "2025-01-01 00:00:00", str(tmp_path / "log"), "b") == 0
    assert {r.statement_id: r.deleted_at and r.deleted_at.year for r in statements.read(spark).collect()} == {0: None, 1: 2024, 2: None, 3: None}
    assert ledger.read(spark).where("statement_id = 1").count() == 0


def test_source_reads_equal_rows_as_a_table_and_as_a_stream(spark, tmp_path):
    spark.dataSource.register(C.CanonicalStatements)
    folder = tmp_path / "in"
    folder.mkdir()

    def file(name, first, n):
        lines = [json.dumps({"fixture": f"é{k}", "transactions": [{"txn_date": "2024-03-01", "amount": f"{k}.50", "description": "x" * (k % 70)}] * (k % 3)}, ensure_ascii=False) for k in range(first, first + n)]
        (folder / name).write_text("\n".join([*lines, "", "not json", '"text"', '{"fixture": "none"}']))

    def whole(size=8_000_000):
        return spark.read.format("canonical_statements").option("pieceBytes", size).load(str(folder))

    def follow():
        stream = spark.readStream.format("canonical_statements").option("pieceBytes", 97).load(str(folder))
        return W.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "log"))

    assert whole().count() == 0
    file("a.json", 0, 50)
    (folder / "_SUCCESS").write_text("")
    assert sorted(map(str, follow().collect())) == sorted(map(str, whole().collect()))
    file("b.json", 50, 31)
    got = sorted(map(str, follow().collect()))
    assert got == sorted(map(str, whole().collect())) == sorted(map(str, whole(400).collect())) == sorted(map(str, whole(64).collect()))
    rows = whole().select("fixture", C.typed("amount"), C.typed("txn_date"), "malformed").collect()
    assert len(rows) == sum(k % 3 for k in range(81)) + 2 * 2 and sum(r.malformed is not None for r in rows) == 4
    assert sum(r.amount or 0 for r in rows) == sum((k + 0.5) * (k % 3) for k in range(81))
