"""The categorisation cascade over rows that no parser settled, near duplicates, and scoring against ground truth."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import similarity, token_set_score
from ..schema import SIMILARITY_FLOOR
from .trust import AUTO_APPROVE_AT, FLAG_AT

HISTORY_THRESHOLD = 3
HISTORY_CONFIDENCE = "0.90"
#: First rows of texts of one key that one task holds against the rows of that key.
TEXTS_A_SLICE = 1_000


def pending(rows: DataFrame) -> DataFrame:
    """Unverified rows without a category, or with the fallback's."""
    return rows.where(~F.col("is_verified") & (F.col("category").isNull() | (F.col("category_source") == "fallback_other")))


def matched_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """tenant_id, txn_id, rule_id and category of the first of its tenant's rules that each row meets: by priority, then the newest.

    rules: tenant_id, rule_id, match_type (exact or contains), pattern, min_amount, max_amount, priority, created_seq,
    category, is_active. Exact rules join on the merchant. A containing rule's pattern is one of LIKE, so that % and _
    stand for anything; it is held against the tenant's distinct merchants, not its rows, and rows meet it by an equality.
    """
    active = rules.where("is_active").withColumn("pattern", F.lower("pattern"))
    named = rows.where("merchant is not null").select("tenant_id", "txn_id", "amount", F.lower("merchant").alias("name"))
    exact = active.where("match_type = 'exact'").withColumnRenamed("pattern", "name")
    within = active.where("match_type = 'contains'").join(named.select("tenant_id", "name").distinct(), "tenant_id")
    within = within.where("name like concat('%', pattern, '%')").drop("pattern")
    both = named.join(exact, ["tenant_id", "name"]).unionByName(named.join(within, ["tenant_id", "name"]))
    fits = (F.col("min_amount").isNull() | (F.col("amount") >= F.col("min_amount"))) & (F.col("max_amount").isNull() | (F.col("amount") <= F.col("max_amount")))
    first = F.min(F.struct("priority", (-F.col("created_seq")).alias("newest"), "rule_id", "category")).alias("hit")
    return both.where(fits).groupBy("tenant_id", "txn_id").agg(first).select("tenant_id", "txn_id", "hit.rule_id", "hit.category")


def historical(rows: DataFrame) -> DataFrame:
    """Per tenant and merchant the category that most verified rows have, three at least; of equals the lowest."""
    seen = rows.where("is_verified and merchant is not null and category is not null").groupBy("tenant_id", "merchant", "category").agg(F.count("*").alias("n"))
    best = seen.where(F.col("n") >= HISTORY_THRESHOLD).groupBy("tenant_id", "merchant").agg(F.min(F.struct((-F.col("n")).alias("less"), "category")).alias("b"))
    return best.select("tenant_id", "merchant", F.col("b.category").alias("category"), (-F.col("b.less")).alias("samples"))


def cascade(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """tenant_id, txn_id, category and tier of each pending row: user rule, history, or still open (for a model, which is not called)."""
    todo = pending(rows).select("tenant_id", "txn_id", "merchant", "amount")
    by_rule = matched_rules(todo, rules).select("tenant_id", "txn_id", F.col("category").alias("by_rule"))
    by_past = historical(rows).select("tenant_id", "merchant", F.col("category").alias("by_past"))
    found = todo.join(by_rule, ["tenant_id", "txn_id"], "left").join(by_past, ["tenant_id", "merchant"], "left")
    tier = F.when(F.col("by_rule").isNotNull(), "user_rule").when(F.col("by_past").isNotNull(), "historical_pattern").otherwise("open")
    return found.select("tenant_id", "txn_id", F.coalesce("by_rule", "by_past").alias("category"), tier.alias("tier"))


def cascade_outcomes(decided: DataFrame) -> DataFrame:
    """Rows of a cascade by tier."""
    return decided.groupBy("tier").agg(F.count("*").alias("n"))


def recategorised(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows with the decisions written: category, its source and confidence, and the review status of the least confidence.

    rows: the ledger with is_verified, category_source and confidence_extraction, _merchant, _category and _validation.
    decided: tenant_id, txn_id, category, tier, confidence. Verified rows, and rows still open, stay as they are.
    """
    new = decided.where("category is not null").select("tenant_id", "txn_id", F.col("category").alias("_to"), F.col("tier").alias("_tier"), F.col("confidence").alias("_sure"))
    both = rows.join(new, ["tenant_id", "txn_id"], "left")
    hit = F.col("_to").isNotNull() & ~F.col("is_verified")
    least = F.least("confidence_extraction", "confidence_merchant", "_sure", "confidence_validation")
    band = F.when(least >= F.lit(AUTO_APPROVE_AT).cast("decimal(6,4)"), "auto_approved").when(least >= F.lit(FLAG_AT).cast("decimal(6,4)"), "flagged").otherwise("review_required")
    written = {"category": F.col("_to"), "category_source": F.col("_tier"), "confidence_category": F.col("_sure"), "review_status": band}
    return both.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in written.items()}).select(rows.columns)


LEARNED_PRIORITY = 10
TENANTS_A_BLOCK = 4_096


def _numbered(names: DataFrame) -> DataFrame:
    """Adds _n, the rank of each row (tenant_id, _name) among all, from 1 without gaps.

    Ranks are counted within the tenant's names of the same first letters; what stands before those is summed by the heads of
    a tenant, the tenants of a block and the blocks. Only the last of these is one task's, a row for each block.
    """
    named = names.withColumns({"_head": F.substring("_name", 1, 3), "_block": F.floor(F.col("tenant_id") / TENANTS_A_BLOCK)})
    heads = named.groupBy("_block", "tenant_id", "_head").agg(F.count("*").alias("n"))
    tenants = heads.groupBy("_block", "tenant_id").agg(F.sum("n").alias("n"))
    blocks = tenants.groupBy("_block").agg(F.sum("n").alias("n"))

    def before(rows: DataFrame, within: list[str], by: str, name: str) -> DataFrame:
        return rows.withColumn(name, F.sum("n").over(Window.partitionBy(*within).orderBy(by)) - F.col("n")).drop("n")

    named = named.join(before(heads, ["_block", "tenant_id"], "_head", "_b1"), ["_block", "tenant_id", "_head"])
    named = named.join(before(tenants, ["_block"], "tenant_id", "_b2"), ["_block", "tenant_id"])
    named = named.join(before(blocks, [], "_block", "_b3"), "_block")
    own = F.row_number().over(Window.partitionBy("tenant_id", "_head").orderBy("_name"))
    return named.withColumn("_n", own + F.col("_b1") + F.col("_b2") + F.col("_b3")).select(*names.columns, "_n")


def learned_rules(rules: DataFrame, corrections: DataFrame) -> DataFrame:
    """The rules after corrections (tenant_id, seq, merchant, category): each merchant's latest correction is a standing exact rule.

    Where the tenant has rules for the merchant, whatever their case, they point at the new category and are active again;
    else one is added. Corrections without a merchant teach nothing. New rules are numbered after the last of all.
    """
    last = corrections.where("merchant is not null and merchant <> ''").groupBy("tenant_id", F.lower("merchant").alias("_name"))
    last = last.agg(F.max_by(F.struct("merchant", "category", "seq"), "seq").alias("_new"))
    old = rules.withColumn("_name", F.lower("pattern")).join(last, ["tenant_id", "_name"], "left")
    taught = F.col("_new").isNotNull()
    old = old.withColumns({"category": F.when(taught, F.col("_new.category")).otherwise(F.col("category")), "is_active": taught | F.col("is_active")})
    fresh = last.join(rules.select("tenant_id", F.lower("pattern").alias("_name")).distinct(), ["tenant_id", "_name"], "left_anti")
    top = rules.agg(F.coalesce(F.max("rule_id"), F.lit(0)).alias("_top"))
    fresh = _numbered(fresh).join(F.broadcast(top))  # one row
    made = {
        "tenant_id": F.col("tenant_id"), "rule_id": F.col("_top") + F.col("_n"), "match_type": F.lit("exact"), "pattern": F.col("_new.merchant"),
        "min_amount": F.lit(None), "max_amount": F.lit(None), "priority": F.lit(LEARNED_PRIORITY), "created_seq": F.col("_new.seq"),
        "category": F.col("_new.category"), "is_active": F.lit(True),
    }
    types = {f.name: f.dataType for f in rules.schema}
    return old.select(rules.columns).unionByName(fresh.select(*(v.cast(types[c]).alias(c) for c, v in made.items())))


def saved_rules(rules: DataFrame, changed: DataFrame) -> DataFrame:
    """The rules with those of the same tenant and number replaced, and others added."""
    return rules.join(changed.select("tenant_id", "rule_id"), ["tenant_id", "rule_id"], "left_anti").unionByName(changed)


def without_rules(rules: DataFrame, removed: DataFrame) -> DataFrame:
    return rules.join(removed.select("tenant_id", "rule_id"), ["tenant_id", "rule_id"], "left_anti")


def rule_list(rules: DataFrame, categories: DataFrame, subcategories: DataFrame) -> DataFrame:
    """The rules whose category is known, with the names of category and subcategory, the newest first."""
    named = rules.join(categories.select(F.col("slug").alias("category"), F.col("name").alias("category_name")), "category")
    named = named.join(subcategories.select(F.col("slug").alias("subcategory"), F.col("name").alias("subcategory_name")), "subcategory", "left")
    return named.orderBy(F.desc("created_seq"), "tenant_id", "rule_id")


def near_duplicates(batch: DataFrame, ledger: DataFrame, floor: float = SIMILARITY_FLOOR) -> DataFrame:
    """Rows of the batch with a ledger row of equal account, date, amount and direction whose narration is nearly the same.

    All such rows with another fingerprint are looked at, and the first by id that passes is named. Such rows are flagged,
    never dropped. Equal narrations of a key stand for each other, so a row meets each of them once, in slices of a key that
    has many of them.
    """
    key = ["tenant_id", "account_id", "txn_date", "amount", "direction"]
    old = ledger.where("fingerprint is not null").select(*key, F.col("txn_id").alias("like_id"), F.col("fingerprint").alias("old_print"), F.coalesce("description", F.lit("")).alias("old_text"))
    # A row passes over one fingerprint, its own: of each text the first row and the first of another fingerprint are enough.
    so_far = Window.partitionBy(*key, "old_text").orderBy("like_id").rowsBetween(Window.unboundedPreceding, 0)
    other = F.col("old_print") != F.col("print")
    old = old.withColumns({"n": F.count("*").over(so_far), "print": F.first("old_print").over(so_far)}).withColumn("others", F.count_if(other).over(so_far))
    old = old.where((F.col("n") == 1) | (other & (F.col("others") == 1))).drop("n", "print", "others")
    old = old.withColumn("slices", F.ceil(F.count("*").over(Window.partitionBy(*key)) / TEXTS_A_SLICE).cast("int"))
    new = batch.select(*key, "txn_id", "fingerprint", F.coalesce("description", F.lit("")).alias("text"))
    hot = old.where("slices > 1").withColumn("slice", F.expr("pmod(xxhash64(old_text), slices)"))
    asked = new.join(hot.groupBy(*key).agg(F.max("slices").alias("of")), key).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    pairs = [new.join(old.where("slices = 1"), key), asked.join(hot, [*key, "slice"])]
    pairs = [p.where("fingerprint <> old_print").select("tenant_id", "txn_id", "text", "like_id", "old_text") for p in pairs]
    both = pairs[0].unionByName(pairs[1]).withColumn("score", similarity("text", "old_text")).where(F.col("score") >= floor)
    first = both.groupBy("tenant_id", "txn_id").agg(F.min(F.struct("like_id", (-F.col("score")).alias("less"))).alias("of"))
    return first.select("tenant_id", "txn_id", "of.like_id", (-F.col("of.less")).alias("score"))


PAIRED = "fixture string, expected_row long, extracted_row long"


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges in the order in which they may be taken (fixture, expected and extracted row): those whose rows are both free.

    An edge that lacks a side stands for its row alone and is taken if the row is free. Holds the rows taken of one fixture.
    """
    fixture, expected, extracted = None, set(), set()
    for batch in batches:
        made = []
        for own, t, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if own != fixture:
                fixture, expected, extracted = own, set(), set()
            if t in expected or x in extracted:
                continue
            if t is not None:
                expected.add(t)
            if x is not None:
                extracted.add(x)
            made.append((own, t, x))
        columns = zip(*made, strict=True) if made else ([],) * 3
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], ["fixture", "expected_row", "extracted_row"])


def align(expected: DataFrame, extracted: DataFrame, description_floor: float = 0.60, date_slack: int = 3) -> DataFrame:
    """Pairs of expected and extracted rows (fixture, row, txn_date, amount, direction, description), fixture by fixture.

    First rows of equal date, amount and direction, the most alike narrations together; what is left pairs with rows
    read wrong: alike enough, and of equal amount or near date. Expected rows choose by their number, of equals the first.
    Unpaired rows come with the other side null. Rows are unique in a fixture; null dates and amounts equal nothing.

    How many rows of a key find no equal one is known from the key's counts, so that only what both sides have over is
    compared for the second step, and both steps are one walk over the edges in the order in which they may be taken.
    """
    key = ["fixture", "txn_date", "amount", "direction"]
    sides = {}
    for name, rows in (("t", expected), ("x", extracted)):
        text = F.upper(F.coalesce("description", F.lit(""))).alias(f"{name}_text")
        sides[name] = rows.select(*key, F.col("row").cast("long").alias(f"{name}_row"), text)
    t, x = sides["t"], sides["x"]
    n_t, n_x = (f.groupBy(*key).agg(F.count("*").alias(f"n_{n}")) for n, f in sides.items())
    over_t = t.join(n_t, key, "left").join(n_x, key, "left").where("coalesce(n_x, 0) < coalesce(n_t, 1)").drop("n_t", "n_x")
    over_x = x.join(n_x, key, "left").join(n_t, key, "left").where("coalesce(n_t, 0) < coalesce(n_x, 1)").drop("n_t", "n_x")

    def edges(rows: DataFrame, kind: int, score: Column) -> DataFrame:
        return rows.select("fixture", F.lit(kind).alias("kind"), "t_row", "x_row", (-score).alias("less"))

    equal = t.join(x, key).join(n_x, key)
    found = edges(equal.where("n_x = 1"), 1, F.lit(0.0))
    found = found.unionByName(edges(equal.where("n_x > 1").withColumn("score", token_set_score("t_text", "x_text")), 1, F.col("score")))
    near = over_x.select("fixture", F.col("txn_date").alias("x_date"), F.col("amount").alias("x_amount"), "x_row", "x_text")
    reach = over_t.select("fixture", F.col("txn_date").alias("t_date"), F.col("amount").alias("t_amount"), "t_row", "t_text")
    by_amount = reach.join(near.withColumn("t_amount", F.col("x_amount")), ["fixture", "t_amount"])
    days = F.explode(F.sequence(F.date_sub("t_date", date_slack), F.date_add("t_date", date_slack)))
    by_date = reach.where("t_date is not null").withColumn("x_date", days).join(near, ["fixture", "x_date"])
    names = ["fixture", "t_row", "x_row", "t_date", "x_date", "t_amount", "x_amount", "t_text", "x_text"]
    both = by_amount.select(names).unionByName(by_date.select(names)).distinct().withColumn("score", token_set_score("t_text", "x_text"))
    apart = F.coalesce(F.abs(F.datediff("x_date", "t_date")), F.lit(30))
    better = F.col("score") + F.when(F.col("x_amount") == F.col("t_amount"), 0.05).otherwise(0.0) - F.least(apart, F.lit(30)) * F.lit(0.001)
    found = found.unionByName(edges(both.where(F.col("score") >= description_floor), 2, better))
    alone = edges(t.withColumn("x_row", F.lit(None).cast("long")), 3, F.lit(0.0))
    found = found.unionByName(alone).unionByName(edges(x.withColumn("t_row", F.lit(None).cast("long")), 3, F.lit(0.0)))
    order = ["fixture", "kind", "t_row", "less", "x_row"]
    return found.repartition("fixture").sortWithinPartitions(*order).select("fixture", "t_row", "x_row").mapInArrow(_settled, PAIRED)


def scorecard(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """Recall, precision and field rates per fixture and, with a null fixture, over all; rates are of the expected rows."""
    fields = ("txn_date", "amount", "direction", "merchant", "category")
    extracted = extracted.select(*(F.col(c).alias(c) for c in extracted.columns))
    sides = [f.select("fixture", F.col("row").alias(f"{s}_row"), *(F.col(c).alias(f"{s}_{c}") for c in fields)) for s, f in (("expected", expected), ("extracted", extracted))]
    pairs = align(expected, extracted).join(sides[0], ["fixture", "expected_row"], "left").join(sides[1], ["fixture", "extracted_row"], "left")
    paired = F.col("expected_row").isNotNull() & F.col("extracted_row").isNotNull()
    fold = lambda c, s: F.lower(F.trim(F.col(f"{s}_{c}"))) if c == "merchant" else F.col(f"{s}_{c}")
    right = {c: F.count_if(paired & fold(c, "expected").eqNullSafe(fold(c, "extracted"))) for c in fields}
    sums = pairs.rollup("fixture").agg(
        F.count("expected_row").alias("expected"), F.count("extracted_row").alias("extracted"), F.count_if(paired).alias("matched"), *(v.alias(f"right_{c}") for c, v in right.items())
    )
    share = lambda a, b: F.coalesce(F.bround(F.col(a) / F.nullif(F.col(b), F.lit(0)), 5), F.lit(1.0)).cast("decimal(6,5)")
    return sums.select("fixture", "expected", "extracted", "matched", share("matched", "expected").alias("recall"), share("matched", "extracted").alias("precision"), *(share(f"right_{c}", "expected").alias(f"{c}_rate") for c in fields))


def accuracy_gate(scores: DataFrame, targets: dict[str, str]) -> DataFrame:
    """A row for each target: the overall score's value, the least asked, and whether it passes."""
    whole = scores.where("fixture is null")
    rows = [F.struct(F.lit(k).alias("measure"), F.col(k).cast("decimal(6,5)").alias("value"), F.lit(v).cast("decimal(6,5)").alias("least")) for k, v in targets.items()]
    return whole.select(F.explode(F.array(*rows)).alias("t")).select("t.*", (F.col("t.value") >= F.col("t.least")).alias("passed"))
