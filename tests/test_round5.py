"""Findings of the fourth round: each test failed before its finding was mended."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import narration as T
from ledgerloom.functions.similarity import token_set_ratio
from ledgerloom.llm import jaccard_join as J
from ledgerloom.operators import anomaly as N
from ledgerloom.operators import categorize as C
from ledgerloom.queries import QUERIES


@pytest.mark.parametrize("texts_a_slice", [1_000, 3])
def test_f5_near_duplicates_look_at_all_rows_of_a_key(spark, monkeypatch, texts_a_slice):
    monkeypatch.setattr(C, "TEXTS_A_SLICE", texts_a_slice, raising=False)
    rng = random.Random(7)
    text = lambda: rng.choice(["ALPHA STORE", "alpha store 1", "BETA SHOP", "GAMMA", "DELTA INN 4", "DELTA INN 5", "", None])
    old = [(f"l{i:03}", rng.choice([f"f{i}", "f1", "f2", None]), text(), rng.choice([5, 5, 5, 6, None])) for i in range(120)]
    old += [("l900", "g", "ZETA", 5), ("l901", "g", "ZETA", 5), ("l902", "h", "ZETA", 5)]
    new = [(f"n{i}", rng.choice([f"f{i}", "f1", None]), text(), rng.choice([5, 6, 7, None])) for i in range(40)]
    new += [("z1", "x", "ZETA", 5), ("z2", "g", "ZETA", 5), ("z3", "h", "ZETAS", 5)]
    key = {"tenant_id": F.lit(1), "account_id": F.lit(2), "txn_date": F.lit("2024-01-01").cast("date"), "direction": F.lit("debit")}
    frames = [spark.createDataFrame(rows, "txn_id string, fingerprint string, description string, amount int").withColumns(key) for rows in (new, old)]
    want = {}
    for i, own, told, amount in new:
        scores = [(r[0], round(token_set_ratio((told or "").upper(), (r[2] or "").upper()), 4)) for r in old if own and r[1] and r[1] != own and r[3] == amount is not None]
        want |= {i: next(x for x in scores if x[1] >= C.SIMILARITY_FLOOR)} if any(x[1] >= C.SIMILARITY_FLOOR for x in scores) else {}
    got = C.near_duplicates(*frames).collect()
    assert len(got) == len(want) and {r.txn_id: (r.like_id, r.score) for r in got} == want
    assert want["z1"][0] == "l900" and want["z2"][0] == "l902"


def test_f1_parts_with_the_same_sets_meet_their_sketches_once(spark, monkeypatch):
    tables, cut = {}, J.cut_lineage
    monkeypatch.setattr(J, "cut_lineage", lambda df, name, *more: tables.setdefault(name, cut(df, name, *more)))
    words = [f"w{i}" for i in range(600)]
    changed = words[:300] + ["x"] + words[301:]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(f"v{i}" for i in range(600))), (4, " ".join(words))]
    got = J.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 1)]
    assert tables["parts"].count() == 2  # of two sets, however many parts they share


def test_f1_a_sketch_has_a_byte_for_each_bin():
    tokens = np.arange(10_000, dtype=np.uint64)
    held = np.frombuffer(J.sketch(tokens), np.uint8)
    assert len(held) == 2_048 and held.sum() == 10_000


def test_f4_a_sweep_finds_its_kinds_one_after_another(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        spent = rng.random() < 0.8
        day = date(2023, 1, 1) + timedelta(rng.randrange(200))
        amount = Decimal(rng.choice([10, 20, 20, 30, 5000 + i]))
        rows.append((1, f"t{i}", rng.choice([1, None]), day, amount, "debit", spent, rng.choice([None, "a", "b", f"m{i}"]), rng.choice([None, "x", "y"]), 9))
    schema = "tenant_id long, txn_id string, statement_id long, txn_date date, amount decimal(18,2), direction string, is_expense boolean, merchant string, category string, account_id long"
    ledger = spark.createDataFrame(rows, schema)
    kept = []

    def keep(found, name):
        kept.append((name, found.count()))
        return found

    want = sorted(map(repr, N.sweep(ledger).collect()))
    assert sorted(map(repr, N.sweep(N.swept(ledger), keep).collect())) == want and {"duplicate_proximity", "merchant_first_large", "amount_outlier"} <= {w.split("kind='")[1].split("'")[0] for w in want}
    assert [name for name, _ in kept] == ["swept-outliers", "swept-spikes", "swept-near", "swept-near", "swept-duplicates", "swept-first"]
    assert kept[3][1] < len([r for r in rows if r[7]])  # rows without a neighbour do not move
    read = {f.split("/")[-2].rsplit("-", 1)[0] for f in QUERIES["A13_anomaly_sweep"](spark, "/root/testdata/sf0.001").inputFiles()}
    assert "swept" not in read and read <= {"swept-outliers", "swept-spikes", "swept-duplicates", "swept-first"}


def test_f2_f3_narrations_are_read_once_and_only_names_that_are_left_move(spark):
    texts = ["POS ACME STORES 1", "UPI-x@ok", "UPI-acme@ok", "POS ACMEE STORESS", "POS WHOLLY UNLIKE", "ATM WDL 7", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, description string")
    aliases = spark.createDataFrame([("Acme", "a", "Acme"), ("Acme Stores", "s", "Acme Stores")], "alias string, slug string, name string")
    kept = []
    named = T.normalize_merchants(rows, aliases, "k", keep=lambda found, name: kept.append((name, found.columns)) or found)
    assert kept == [("narrations", ["k", "description", "hit", "vpa", "rail", "hay"])]
    got = {r.k: (r.merchant, r.slug, r.merchant_match) for r in named.collect()}
    assert got == {r.k: (r.merchant, r.slug, r.merchant_match) for r in T.normalize_merchants(rows, aliases, "k").collect()} and len(got) == len(texts)
    assert [got[k][2] for k in range(6)] == ["dictionary_alias", "unmatched_residue", "dictionary_alias", "fuzzy", "unmatched_residue", "no_merchant_for_rail"]
    assert named._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # rows of which no name is left meet none
    for name in ("F16_C1_enriched", "F11_F13_F15_J14_merchants"):
        assert all("/narrations-" in f for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles())


def test_f2_f3_haystacks_are_those_of_ranges(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("aZ09 -_/[`{@éİß  \n\t\U0001f600K", k=rng.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    before = F.trim(F.regexp_replace(F.regexp_replace(F.upper(T.collapse("t")), "[^A-Z0-9 ]+", " "), r"\s+", " "))
    assert rows.where(~T.haystack("t").eqNullSafe(before)).count() == 0
