"""Jaccard join, suffix dedup and exact dedup against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, jaccard_join, suffix_dedup
from tests.llm import cases


@pytest.mark.parametrize(("seed", "n", "num", "den", "slice_"), [(1, 3, 90, 100, 10**6), (2, 5, 80, 100, 10**6), (3, 3, 90, 100, 1_500), (4, 5, 80, 100, 1_500)])
def test_components_equal_those_of_all_pairs(spark, seed, n, num, den, slice_):
    rows = cases.near_copies(seed)
    got = jaccard_join.similar(cases.frame(spark, rows), n, num, den, slice_).collect()
    assert sorted(tuple(r) for r in got) == cases.linked(rows, n, num, den)


def test_similar_takes_empty_tables_null_ids_and_repeated_rows(spark):
    assert jaccard_join.similar(cases.frame(spark, [(1, "a")]).limit(0)).count() == 0
    got = jaccard_join.similar(cases.frame(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (4, "x y z"), (5, "x y z")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got if r.doc_id) == [(4, 4), (5, 4), (5, 5), (5, 5)]
    assert len(got) == 5


def _colliding_words():
    """Two words of 34 blocks with equal hashes by the fixed key: blocks are equal modulo 2**64, and the prime falls to a birthday search."""
    import numpy as np

    from ledgerloom.llm.textblock import FIXED_KEY, TextBlock, _bases

    block = b"a"
    while len(block) < 2_048:
        block += block.translate(bytes.maketrans(b"ab", b"ba"))
    blocks, prime, base = (block, block.translate(bytes.maketrans(b"ab", b"ba"))), 2**31 - 1, _bases(FIXED_KEY)[1]
    apart = sum((blocks[1][i] - blocks[0][i]) * pow(base, i, prime) for i in range(2_048))
    steps = np.array([apart * pow(base, 2_048 * i, prime) % prime for i in range(34)])
    chosen = np.random.default_rng(0).integers(0, 2, (1 << 18, 34))
    sums, at, n = np.unique((chosen @ steps) % prime, return_index=True, return_counts=True)
    one = at[n > 1][0]
    same = np.flatnonzero((chosen @ steps) % prime == (chosen[one] @ steps) % prime)
    other = next(i for i in same if (chosen[i] != chosen[one]).any())
    words = [b"".join(blocks[k] for k in chosen[i]) for i in (one, other)]
    held = TextBlock(words)
    assert words[0] != words[1] and len(set(held.hashes(held.starts, held.ends).tolist())) == 1
    return words


def test_words_made_to_collide_under_the_known_key_do_not_link(spark):
    rows = [(i, w.decode()) for i, w in enumerate(_colliding_words())]
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.similar(cases.frame(spark, rows)).collect()) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("n", [3, 5])
def test_parts_that_many_sets_share_are_tied_unseen(spark, monkeypatch, n):
    monkeypatch.setattr(jaccard_join, "NEAR", 3)
    rows = cases.near_copies(6)
    assert sorted(tuple(r) for r in jaccard_join.similar(cases.frame(spark, rows), n, 85, 100, 2_000).collect()) == cases.linked(rows, n, 85, 100)


def test_merges_by_heap_and_by_counting_find_the_same():
    import numpy as np

    rng = np.random.default_rng(0)
    whole = np.sort(rng.choice(1 << 40, 400, replace=False)).astype(np.uint64)
    sets = [np.sort(rng.choice(whole, 395 - i % 40, replace=False)) for i in range(120)]
    index = jaccard_join.InvertedIndex(sets)
    even = lambda members: members % 2 == 0
    for entries in (0, 10**9):
        jaccard_join.HEAP_ENTRIES, before = entries, jaccard_join.HEAP_ENTRIES
        try:
            for i in (0, 7, 39):
                shared = [len(np.intersect1d(sets[i], s)) for s in sets]
                want = [j for j, k in enumerate(shared) if j % 2 == 0 and 100 * k >= 90 * (len(sets[i]) + len(sets[j]) - k)]
                assert index.search(sets[i], 90, 100, even) == want
        finally:
            jaccard_join.HEAP_ENTRIES = before


def test_of_linked_documents_the_smallest_stays(spark):
    rows = cases.near_copies(5)
    kept = {r.doc_id for r in jaccard_join.dedup_similar(cases.frame(spark, rows)).collect()}
    assert kept == {c if n else i for i, n, c in cases.linked(rows, 5, 80, 100)}


def test_linked_sets_always_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(0)
    for size in (3, 10, 11, 40, 150, 209, 600):
        for num in (80, 90):
            whole = rng.integers(0, 1 << 63, size * 2).astype(np.uint64)
            least = -(-num * size // 100)
            other = np.sort(whole[:least])  # a subset, as small as a link allows
            common = rng.random(size) < 0.5
            order = np.argsort(whole[:size])
            a = jaccard_join.signatures(whole[:size][order], common[order], num, 100)
            b = jaccard_join.signatures(other, common[:least][np.argsort(whole[:least])], num, 100)
            assert set(a.tolist()) & set(b.tolist())


@pytest.mark.parametrize(("seed", "segments", "batch"), [(1, 5_000, 20_000), (2, 3, 50)])
def test_removed_bytes_equal_those_of_all_windows(spark, monkeypatch, seed, segments, batch):
    monkeypatch.setattr(suffix_dedup, "SEGMENTS", segments)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    rows = cases.shared_passages(seed)
    got = suffix_dedup.dedup_substrings(cases.frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == cases.cut(rows)


def test_suffix_dedup_carries_columns_and_takes_repeated_ids(spark):
    passage = "".join(random.Random(0).choices("abcdefgh", k=150))
    rows = [(1, passage), (1, passage), (None, "short"), (2, "é" + passage + "!")]
    got = suffix_dedup.dedup_substrings(cases.frame(spark, rows), carry=("label",)).orderBy("doc_id", "n_removed").collect()
    assert [(r.doc_id, r.n_removed, r.text) for r in got] == [(None, 0, "short"), (1, 0, passage), (1, 150, ""), (2, 150, "é!")]
    assert {r.carried.label for r in got} == {7}
    assert suffix_dedup.dedup_substrings(cases.frame(spark, rows).limit(0)).count() == 0


def plain_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(i)
    return sorted((i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda c: F.lit("all alike"), lambda c: F.substring(F.md5(c), 1, 1)])
def test_exact_groups_even_when_hashes_collide(spark, hashed):
    rows = cases.ODD + [(i, f"text {i % 7}") for i in range(100)]
    got = exact_dedup.exact_groups(cases.frame(spark, rows), hashed=hashed).collect()
    assert sorted(tuple(r) for r in got) == plain_groups(rows)


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (3, "b"), (1, "c")]
    got = exact_dedup.dedup_exact(cases.frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a"), (1, "c"), (3, "b")]
    assert exact_dedup.exact_groups(cases.frame(spark, rows).limit(0)).count() == 0
