"""Transfer pairing and fuzzy names against plain versions that compare all with all."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import narration as T
from ledgerloom.functions.similarity import common_subsequence, token_set_ratio
from ledgerloom.operators import categorize as C
from ledgerloom.operators import movement as J

ROWS = "tenant_id long, txn_id string, account_id long, txn_date date, amount decimal(18,2), direction string, movement_type string, is_expense boolean"


def plain_pairs(rows, days=3):
    """Rows take turns by date and id, and each looks at all others."""
    free = {(r[0], r[1]): r for r in rows if None not in (r[2], r[3], r[4])}
    pairs = []
    for r in sorted(free.values(), key=lambda r: (r[3], r[1])):
        if (r[0], r[1]) not in free or r[6] not in ("transfer", "credit_card_payment"):
            continue
        near = [o for o in free.values() if o[0] == r[0] and o[4] == r[4] and {o[5], r[5]} == {"debit", "credit"} and o[2] != r[2] and abs((o[3] - r[3]).days) <= days]
        if near:
            best = min(near, key=lambda o: (abs((o[3] - r[3]).days), o[1]))
            del free[r[0], r[1]], free[best[0], best[1]]
            pairs.append((r[0], r[4], r[1], best[1], abs((best[3] - r[3]).days)))
    return sorted(pairs)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_equal_those_of_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    day = date(2024, 1, 1)
    rows = [
        (rng.choice([1, 1, 2]), f"t{i:03}" if rng.random() < 0.9 else f"é{i}", rng.choice([10, 10, 11, 12]), day + timedelta(rng.choice([0, 1, 2, 5, 9, 13, 14, 40]) + rng.randint(0, 3)),
         Decimal(rng.choice([5, 5, 7])), rng.choice(["debit", "credit"]), rng.choice(["transfer", "credit_card_payment", "expense", None]), True)
        for i in range(300)
    ]
    rows += [(1, "n1", None, day, Decimal(5), "debit", "transfer", True), (1, "n2", 3, None, Decimal(5), "debit", "transfer", True), (1, "n3", 3, day, Decimal(5), None, "transfer", True)]
    ledger = spark.createDataFrame(rows, ROWS)
    pairs = J.pair_transfers(ledger)
    assert sorted(tuple(r) for r in pairs.collect()) == plain_pairs([r for r in rows if r[5]])
    left = {(r.tenant_id, r.txn_id) for r in J.without_paired(ledger, pairs).where("is_expense").collect()}
    assert left == {(r[0], r[1]) for r in rows} - {(p[0], t) for p in plain_pairs([r for r in rows if r[5]]) for t in (p[2], p[3])}
    assert J.pair_transfers(ledger.limit(0)).count() == 0


def test_an_amount_with_very_many_rows_a_day_pairs_by_rank(spark):
    """10^5 rows of one tenant, amount and day, and half as many of the other direction a day later: all pairs would be 10^10."""
    n = 50_000
    key = F.lpad(F.col("id").cast("string"), 6, "0")
    sent = spark.range(2 * n).select(F.lit(1).cast("long").alias("tenant_id"), F.concat(F.lit("a"), key).alias("txn_id"), (F.col("id") % 1000).alias("account_id"), F.lit("2024-01-01").cast("date").alias("txn_date"),
        F.lit(9).cast("decimal(18,2)").alias("amount"), F.lit("debit").alias("direction"), F.lit("transfer").alias("movement_type"), F.lit(True).alias("is_expense"))
    got = spark.range(n).select(F.lit(1).cast("long").alias("tenant_id"), F.concat(F.lit("b"), key).alias("txn_id"), (-1 - F.col("id") % 1000).alias("account_id"), F.lit("2024-01-02").cast("date").alias("txn_date"),
        F.lit(9).cast("decimal(18,2)").alias("amount"), F.lit("credit").alias("direction"), F.lit("income").alias("movement_type"), F.lit(False).alias("is_expense"))
    pairs = J.pair_transfers(sent.unionByName(got))
    assert pairs.where("substring(txn_id, 2) = substring(paired_with, 2) and gap_days = 1").count() == pairs.count() == n


def test_common_subsequence_equals_the_table_of_all_prefixes():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randint(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert common_subsequence(a, b) == row[-1]


def plain_fuzzy(names, aliases, floor):
    found = []
    for hay in names:
        scored = [(-token_set_ratio(hay, a), -len(a), a) for a in aliases]
        less, _, best = min(scored)
        if -less < floor or (min(len(hay), len(best)) <= 6 and hay not in best and best not in hay):
            continue
        found.append((hay, best, round(-less, 9)))
    return sorted(found)


@pytest.mark.parametrize(("seed", "floor"), [(1, 0.88), (2, 0.88), (3, 0.80), (4, 0.95)])
def test_fuzzy_matches_equal_those_of_all_pairs(spark, seed, floor):
    rng = random.Random(seed)
    base = ["NETFLIXSUBSCRIPTION", "THE CORNER BAKERY", "THE", "ZEPTO", "AB CD", "A B C", "LONGESTWORDOFALL THE SHOP", "BIG BAZAAR", "XX XX", "MILK MILKY MILKMAN", "ABABABAB"]
    word = lambda: "".join(rng.choice("ABCDE") for _ in range(rng.randint(1, 7)))

    def changed(text):
        text = list(text)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            k = rng.randrange(len(text) + 1)
            text[k : k + rng.choice([0, 1])] = rng.choice(["", "A", "Q", " "])
        words = "".join(text).split()
        if rng.random() < 0.4:
            rng.shuffle(words)
        if rng.random() < 0.4:
            words.insert(rng.randint(0, len(words)), rng.choice(["THE", "OF", word()]))
        return " ".join(words)

    aliases = sorted({*base, *(" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(60))})
    names = sorted({changed(rng.choice(aliases)) for _ in range(250)} - {""} | {"ANETFLIXSUBSCRIPTION", "THE THE"})
    left = spark.createDataFrame([(n,) for n in names] + [("",), (None,)], "hay string")
    right = spark.createDataFrame([(a, a.lower()) for a in aliases], "alias string, slug string")
    got = T.fuzzy_matches(left, right, floor).collect()
    assert sorted((r.hay, r.alias, round(r.score, 9)) for r in got) == plain_fuzzy(names, aliases, floor)
    assert all(r.slug == r.alias.lower() for r in got)


def test_normalised_merchants_have_a_fuzzy_tier(spark):
    rows = spark.createDataFrame([(1, "POS NETFLIX SUBSCRIPTIONN 998877"), (2, "POS NETFLIX SUBSCRIPTION 1"), (3, "POS WHOLLY UNLIKE"), (4, "POS SUBSCRIPTION NETFLIX")], "id long, description string")
    aliases = spark.createDataFrame([("NETFLIX SUBSCRIPTION", "netflix", "Netflix")], "alias string, slug string, name string")
    got = {r.id: (r.merchant, r.slug, float(r.merchant_confidence), r.merchant_match) for r in T.normalize_merchants(rows, aliases, "id").collect()}
    assert got[2] == ("Netflix", "netflix", 0.99, "dictionary_alias") and got[3][2:] == (0.5, "unmatched_residue")
    assert got[4] == ("Netflix", "netflix", 0.95, "fuzzy")
    assert got[1][3] == "fuzzy" and 0.75 <= got[1][2] < 0.95


TRUTH = "fixture string, row long, txn_date date, amount decimal(18,2), direction string, description string"


def plain_alignment(expected, extracted, floor=0.60, slack=3):
    made = []
    for fixture in sorted({r[0] for r in expected + extracted}):
        free = sorted((r for r in extracted if r[0] == fixture), key=lambda r: r[1])
        later = []
        like = lambda t, x: token_set_ratio((t[5] or "").upper(), (x[5] or "").upper())
        for t in sorted((r for r in expected if r[0] == fixture), key=lambda r: r[1]):
            same = [x for x in free if x[2:5] == t[2:5]]
            if same:
                best = max(same, key=lambda x: like(t, x))
                free.remove(best)
                made.append((fixture, t[1], best[1]))
            else:
                later.append(t)
        for t in later:
            best, top = None, 0.0
            for x in free:
                days, score = abs((x[2] - t[2]).days), like(t, x)
                if score >= floor and (x[3] == t[3] or days <= slack) and (score := score + 0.05 * (x[3] == t[3]) - min(days, 30) * 0.001) > top:
                    best, top = x, score
            if best:
                free.remove(best)
            made.append((fixture, t[1], best and best[1]))
        made += [(fixture, None, x[1]) for x in free]
    return sorted(made, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_alignment_equals_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    day = date(2024, 3, 1)
    row = lambda i: (rng.choice("fgh"), i, day + timedelta(rng.randint(0, 12)), Decimal(rng.randint(1, 4)), rng.choice(["debit", "credit"]), rng.choice([None, "POS SHOP", "POS SHOP A", "shop pos b", "UPI ASHA", "UPI ASHA K", "NEFT"]))
    expected = [row(i) for i in range(70)]
    extracted = [r if rng.random() < 0.6 else row(r[1]) for r in expected if rng.random() < 0.9] + [row(i) for i in range(100, 120)]
    got = C.align(spark.createDataFrame(expected, TRUTH), spark.createDataFrame(extracted, TRUTH)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_alignment(expected, extracted)
    assert C.align(spark.createDataFrame([], TRUTH), spark.createDataFrame(extracted[:2], TRUTH)).count() == 2


def test_near_duplicates_look_at_the_first_five_others_of_a_hot_key(spark):
    """Every row has the same key; fingerprints repeat, and a row passes over those equal to its own."""
    rng = random.Random(5)
    old = [(f"l{i:03}", f"f{rng.randrange(4) if i < 30 else i}", rng.choice(["ALPHA STORE", "BETA SHOP"])) for i in range(60)]
    new = [(f"n{i}", f"f{i}", "ALPHA STORES") for i in range(6)]
    schema = "txn_id string, fingerprint string, description string"
    key = {"tenant_id": F.lit(1), "account_id": F.lit(2), "txn_date": F.lit("2024-01-01").cast("date"), "amount": F.lit(5), "direction": F.lit("debit")}
    frames = [spark.createDataFrame(rows, schema).withColumns(key) for rows in (new, old)]
    got = {r.txn_id: r.like_id for r in C.near_duplicates(*frames).collect()}
    firsts = {i: [r for r in old if r[1] != f][:5] for i, f, _ in new}
    assert got == {i: next(r[0] for r in rows if r[2] == "ALPHA STORE") for i, rows in firsts.items() if any(r[2] == "ALPHA STORE" for r in rows)}


def test_a_score_with_a_floor_is_computed_once(spark):
    """pushed below the score, the floor had a second Python worker in each task score the pairs that pass again."""
    key = {"tenant_id": F.lit(1), "account_id": F.lit(2), "txn_date": F.lit("2024-01-01").cast("date"), "amount": F.lit(5), "direction": F.lit("debit")}
    texts = ["ALPHA STORE", "alpha store no 1", "Straße 5", "STRASSE 5", "", None]
    old = spark.createDataFrame([(f"l{i}", f"f{i}", t) for i, t in enumerate(texts)], "txn_id string, fingerprint string, description string").withColumns(key)
    again = old.withColumns({"txn_id": F.concat(F.lit("n"), "txn_id"), "account_id": F.substring("txn_id", 2, 1).cast("int")})
    pairs = C.near_duplicates(again, old.withColumns({"account_id": (F.substring("txn_id", 2, 1).cast("int") + 1) % 6}))
    assert {(r.txn_id, r.like_id, r.score) for r in pairs.collect()} == {("nl1", "l0", 1.0), ("nl3", "l2", 1.0)}

    names, aliases = old.select(F.col("description").alias("hay")), old.select(F.col("description").alias("alias"), F.col("txn_id").alias("slug"))
    row = F.substring("txn_id", 2, 1).cast("long")
    sides = [old.select(F.lit("f").alias("fixture"), row.alias("row"), "txn_date", (row + n).cast("decimal(18,2)").alias("amount"), "direction", "description") for n in (0, 1)]
    for frame, times in ((pairs, 1), (T.fuzzy_matches(names, aliases), 1), (C.align(*sides), 2)):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("ArrowEvalPython") == times, plan


def test_learned_rules_are_numbered_without_gaps_over_tenants_blocks(spark):
    schema = "tenant_id long, rule_id int, match_type string, pattern string, min_amount int, max_amount int, priority int, created_seq int, category string, is_active boolean"
    rules = spark.createDataFrame([(1, 7, "exact", "known", None, None, 5, 1, "A", True)], schema)
    rng = random.Random(6)
    named = sorted({(rng.choice([1, 2, 5_000, 5_001, 90_000]), "".join(rng.choices("abé ", k=rng.randint(1, 5)))) for _ in range(200)} | {(1, "known")})
    corrections = spark.createDataFrame([(t, i, m, "B") for i, (t, m) in enumerate(named)], "tenant_id long, seq int, merchant string, category string")
    got = {r.rule_id: (r.tenant_id, r.pattern) for r in C.learned_rules(rules, corrections).collect()}
    fresh = sorted(((t, m) for t, m in named if (t, m) != (1, "known")), key=lambda x: (x[0], x[1].encode()))
    assert got == {7: (1, "known")} | {8 + i: x for i, x in enumerate(fresh)}


def test_keyed_hash_equals_the_library(spark):
    import hashlib
    import hmac

    from ledgerloom.operators.trust import keyed_hash

    texts = ["", "a:b", "é" * 100]
    for key in (b"", b"short", b"k" * 64, b"long" * 40):
        got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(keyed_hash(F.col("t"), key).alias("h")).collect()
        assert [r.h for r in got] == [*(hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts), None]
