"""Sharding, quality rules, the quality classifier and toxicity."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import quality_classifier, quality_rules, sharding, toxicity
from ledgerloom.llm.textblock import U64, text_blocks
from tests.llm import cases

SOURCED = "text string, doc_id long, source string, size string"


@pytest.mark.parametrize("a_slice", [20_000, 13])
def test_shards_are_even_and_keep_the_mixture(spark, a_slice):
    rows = [(f"t{i}", i, ["hot", "hot", None, "b", "c"][i % 5], "x") for i in range(403)]
    got = sharding.interleave(spark.createDataFrame(rows, SOURCED), rows_a_slice=a_slice).collect()
    assert sorted(r.doc_id for r in got) == list(range(403)) and {r.law for r in got} == {"rows"}
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert len(own) in (50, 51) and sorted(r.slot for r in own) == list(range(len(own)))
        mix = Counter(r.source for r in own)
        assert abs(mix["hot"] - len(own) * 0.4) <= 2 and abs(mix[None] - len(own) * 0.2) <= 2
    assert all(r.size == len(f"t{r.doc_id}") + 1 and r.text_crc32 == zlib.crc32(f"t{r.doc_id}".encode()) and r.grown_shard is None for r in got)


def test_sharding_odd_tables(spark):
    rows = [(None, None, None, "x"), ("a", 1, "s", "x"), ("a", 1, "s", "x")]
    got = sharding.interleave(spark.createDataFrame(rows, SOURCED)).collect()
    assert sorted(r.size for r in got) == [1, 2, 2] and len({(r.shard, r.slot) for r in got}) == 3
    assert sharding.interleave(spark.createDataFrame(rows, SOURCED).limit(0)).count() == 0


def test_slices_do_not_change_shards(spark):
    rows = spark.createDataFrame([(f"t{i}", i, f"s{i % 3}", "x") for i in range(100)], SOURCED)
    one, many = (sorted(tuple(r) for r in sharding.interleave(rows, rows_a_slice=n).collect()) for n in (1_000, 7))
    assert one == many


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i}", i, f"s{i % 3}", "x") for i in range(50)], SOURCED)
    sharding.write_shards(rows, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(r.doc_id for r in back.collect()) == list(range(50)) and back.select("shard").distinct().count() == 8


def plain_measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_plain_counts(spark):
    rng = random.Random(0)
    rows = cases.ODD + [(i, rng.choice([" ", "\n"]).join(rng.choice("ab#") for _ in range(rng.randrange(60)))) for i in range(60)]
    got = quality_rules.quality_rules(cases.frame(spark, rows)).collect()
    for r in got:
        want = plain_measures(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and not r.broken_rules)


def test_rules_name_what_is_broken(spark):
    good = "The cat and the dog went to the house of the man who had not seen it for years and years"
    got = {r.doc_id: r.broken_rules for r in quality_rules.quality_rules(cases.frame(spark, [(1, good), (2, good.upper()), (3, good.replace(" ", " # "))])).collect()}
    assert got == {1: [], 2: ["stop_ratio"], 3: ["symbol_ratio"]}
    assert quality_rules.quality_rules(cases.frame(spark, [(1, "a")]).limit(0)).count() == 0


def corpus(n=400, seed=0):
    """Documents with good and junk texts, some with insults, and their labels."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioustnr") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        if not good:
            text = [w.upper() + "!!" for w in text] if rng.random() < 0.5 else [w + rng.choice(["###", "$$$"]) for w in text]
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["moron", "scumbag", "worthless"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize(("operator", "column", "bar"), [(quality_classifier.classify, 1, 0.3), (toxicity.toxicity, 2, 0.5)])
def test_held_out_accuracy_and_no_use_of_held_out_labels(spark, operator, column, bar):
    docs, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in operator(cases.frame(spark, docs + cases.ODD), table).collect()}
    assert len(got) == len(docs) + len(cases.ODD) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == fold(i) and r.predicted == int(r.score >= bar) for i, r in got.items())
    right = [got[x[0]].predicted == x[column] for x in labels if fold(x[0])]
    assert sum(right) >= 0.9 * len(right)
    flipped = [(i, 1 - q, 1 - t) if fold(i) else (i, q, t) for i, q, t in labels]
    again = operator(cases.frame(spark, docs + cases.ODD), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({i: r.score for i, r in got.items()})


@pytest.mark.parametrize("operator", [quality_classifier.classify, toxicity.toxicity])
def test_scores_without_labels_or_rows(spark, operator):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = operator(cases.frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), none).collect()
    assert [r.score for r in got] == [0.5] * 3
    assert operator(cases.frame(spark, [(1, "a")]).limit(0), none).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(80)]
    ratios = np.zeros(1 << quality_classifier.BITS)
    ratios[:40] = rng.normal(size=40)
    y = np.array([1 if (x < 20).sum() > 4 else -1 for x in rows])
    w, bias = quality_classifier.dual_coordinate_descent(rows, ratios, y, 1.0, 3_000)
    share = {k: len(y) / 2 / (y == k).sum() for k in (1, -1)}

    def loss(w, bias):
        margins = np.array([w[x] @ quality_classifier._unit(ratios[x]) + bias for x in rows])
        return (w @ w + bias**2) / 2 + sum(share[k] * max(0, 1 - k * m) for k, m in zip(y, margins))

    best = loss(w, bias)
    for _ in range(50):
        step = np.zeros_like(w)
        step[:40] = rng.normal(size=40) * 1e-3
        assert loss(w + step, bias + rng.normal() * 1e-3) >= best - 1e-4


def test_block_max_index_finds_the_exact_neighbours():
    rng = np.random.default_rng(0)
    dense = np.where(rng.random((300, 30)) < 0.15, rng.random((300, 30)), 0)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    dense[7] = dense[8] = dense[9]  # ties
    row, term = np.nonzero(dense)
    ids = rng.permutation(1000)[:300]
    index = toxicity.BlockMaxIndex(ids, term, row, dense[row, term], 30, block=16)
    lengths = np.bincount(row, minlength=300)
    q, near, cosine = index.nearest(term, dense[row, term], lengths, 7)
    for i in range(300):
        dots = dense @ dense[i]
        want = [k for k in np.lexsort((ids, -np.round(dots, 9))) if dots[k] > 0][:7]
        assert index.ids[near[q == i]].tolist() == ids[want].tolist()
        assert np.allclose(cosine[q == i], dots[want])


def test_texts_go_in_small_blocks_and_scores_do_not_depend_on_them():
    texts = [b"Some words %d of text " % i * 40 for i in range(1_000)]
    blocks = list(text_blocks(pa.array(texts, pa.binary())))
    assert b"".join(t for _, _, own in blocks for t in own) == b"".join(texts)
    assert max(sum(map(len, own)) for _, _, own in blocks) < 300_000
    model = quality_classifier.Model([], np.zeros(0), {})
    model.slope = 1.0
    model.ratios, model.weights = np.random.default_rng(0).normal(size=(2, 1 << quality_classifier.BITS)).astype(np.float32)
    whole = model.scores(texts)
    assert np.array_equal(np.concatenate([model.scores(own) for _, _, own in blocks]), whole) and len(set(whole.tolist())) > 1


def test_common_terms_lie_as_rows_of_a_matrix_and_not_in_the_lists():
    rng = np.random.default_rng(1)
    common = np.where(rng.random((400, 60)) < 0.5, rng.random((400, 60)), 0)
    rare = np.where(rng.random((400, 900)) < 0.01, 3 * rng.random((400, 900)), 0)
    dense = np.hstack([rare, common])
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    row, term = np.nonzero(dense)
    ids, lengths = rng.permutation(400), np.bincount(row, minlength=400)
    index = toxicity.BlockMaxIndex(ids, term, row, dense[row, term], 960, block=16)
    assert len(index.weight) == np.count_nonzero(rare) and len(index.matrix) == 60
    q, near, cosine = index.nearest(term, dense[row, term], lengths, 5)
    for i in range(0, 400, 7):
        dots = dense @ dense[i]
        want = [k for k in np.lexsort((ids, -np.round(dots, 9))) if dots[k] > 0][:5]
        assert index.ids[near[q == i]].tolist() == ids[want].tolist()
        assert np.allclose(cosine[q == i], dots[want])


def test_toxicity_equals_a_dense_brute_force(spark):
    docs, labels = corpus(150, seed=3)
    docs += [(1000, ""), (1001, None), (1002, "scumbag " * 30_000), (1003, "zzz yyy xxx")]
    got = toxicity.toxicity(cases.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    words = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in docs}
    y = {i: t for i, _, t in labels if not fold(i)}
    vocabulary = sorted({w for i in y for w in words[i]})
    counts = np.array([[words[i][w] for w in vocabulary] for i, _ in docs], float)
    inside = np.array([i in y for i, _ in docs])
    own = np.array([y.get(i, 0) for i, _ in docs])
    has = counts > 0
    idf = np.log((len(docs) + 1) / (has.sum(axis=0) + 1)) + 1
    at = np.flatnonzero(inside)
    prior = (own[inside].sum() + 1) / (len(at) + 2)

    def shares(examples, queries):
        a, b = (has[examples[own[examples] == k]].sum(axis=0) + 0.5 for k in (1, 0))
        na, nb = ((own[examples] == k).sum() + 1 - x for k, x in ((1, a), (0, b)))
        z = np.log(a * nb / (b * na)) / np.sqrt(1 / a + 1 / b + 1 / na + 1 / nb)
        w = np.where(has, 1 + np.log(np.maximum(counts, 1)), 0) * idf * np.maximum(1, z * z / 4)
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
        found = []
        for k in queries:
            dots = w[examples] @ w[k]
            near = [n for n in np.lexsort((examples, -np.round(dots, 9))) if dots[n] > 0][: toxicity.NEIGHBOURS]
            found.append((dots[near] @ own[examples[near]] + toxicity.PRIOR * prior) / (dots[near].sum() + toxicity.PRIOR))
        return np.array(found)

    crossed = np.zeros(len(at))
    for k in range(toxicity.FOLDS):
        fold_of = np.arange(len(at)) % toxicity.FOLDS
        crossed[fold_of == k] = shares(at[fold_of != k], at[fold_of == k])
    near = shares(at, range(len(docs)))
    slope, offset = quality_classifier.logistic(crossed, np.where(own[inside] == 1, 1, -1), np.ones(len(at)))
    want = 1 / (1 + np.exp(-(slope * near + offset)))
    want[counts.sum(axis=1) == 0] = prior  # no labelled text is without terms
    assert {r.doc_id: r.score for r in got} == pytest.approx({i: s for (i, _), s in zip(docs, want)}, abs=1e-6)


def test_words_of_thue_and_morse_have_hashes_of_their_own():
    from ledgerloom.llm.jaccard_join import shingle_sets
    from ledgerloom.llm.textblock import TextBlock

    word = b"a"
    while len(word) < 2_048:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    for n in (1_024, 2_048):
        assert shingle_sets([word[:n]], 3)[0].tolist() != shingle_sets([other[:n]], 3)[0].tolist()
    block = TextBlock([word, b"x" + word, other])
    h = block.hashes(np.array([0, 2_050, 4_099]), np.array([2_048, 4_098, 6_147]))
    assert h[0] == h[1] != h[2]


def test_written_shards_replace_columns_of_their_names(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i}", i, f"s{i % 3}", 9, 9) for i in range(20)], "text string, doc_id long, source string, shard int, slot int")
    sharding.write_shards(rows, f"file://{tmp_path}/clash")
    assert spark.read.parquet(f"file://{tmp_path}/clash").where("shard < 8").count() == 20


def test_sliding_least():
    from ledgerloom.llm.suffix_dedup import sliding_least

    x = np.random.default_rng(0).integers(0, 1 << 60, 500).astype(U64)
    for n in (1, 2, 3, 8, 77):
        assert sliding_least(x, n).tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]


def test_rules_of_null_and_repeated_rows(spark):
    got = quality_rules.quality_rules(cases.frame(spark, [(None, "a b"), (1, "a b"), (1, "a b"), (1, None)])).collect()
    assert sorted((r.doc_id is None, r.n_words) for r in got) == [(False, 0), (False, 2), (False, 2), (True, 2)]
