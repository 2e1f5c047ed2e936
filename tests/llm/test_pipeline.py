"""The corpus pipeline against its stages done plainly, and the registered queries over a small corpus."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from ledgerloom.llm import common, quality_classifier, queries
from tests.llm import cases
from tests.llm.test_scores import corpus


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with copies, near copies, shared passages and junk, and labels of some."""
    folder = f"file://{tmp_path_factory.mktemp('small')}"
    docs, labels = corpus(240, seed=3)
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randrange(500)}" for _ in range(60))
    docs += [(1000 + i, t) for i, (_, t) in enumerate(docs[:30])]
    docs += [(1100 + i, t + " " + passage) for i, (_, t) in enumerate(docs[30:50])]
    docs += [(1200 + i, t + " end") for i, (_, t) in enumerate(docs[50:80])]
    docs += cases.ODD
    frame = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_equals_its_stages_done_plainly(spark, small):
    columns = common.documents(spark, small).columns
    stages, docs = {}, common.documents(spark, small)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut_lineage(stage(spark, docs, small), "stage")
        assert docs.columns == columns
        stages[name] = {r.doc_id: r.text for r in docs.collect()}
    start = common.documents(spark, small)
    model = quality_classifier.fit(start, common.labels(spark, small))
    rows = [(r.doc_id, r.text) for r in start.collect()]
    scores = model.scores([(t or "").encode() for _, t in rows])
    want = {i: t for (i, t), s in zip(rows, scores) if s >= 0.3}
    assert stages["quality classifier"] == want
    first = {}
    for i in sorted(want):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", want[i] or ""), i)
    want = {i: want[i] for i in first.values()}
    assert stages["exact dedup"] == want
    linked = cases.linked(list(want.items()), 5, 80, 100)
    want = {i: want[i] for i, n, c in linked if i == c}
    assert stages["n-gram Jaccard join"] == want
    removed = {i: r for i, _, r, _, _ in cases.cut(list(want.items()))}
    assert set(want) >= set(stages["suffix-array dedup"]) and sum(removed.values()) > 0
    for i, text in stages["suffix-array dedup"].items():
        assert len(text.encode()) == len((want[i] or "").encode()) - removed[i]
    packed = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in packed} == set(stages["suffix-array dedup"])


#: Their rows are nodes of conversations and ranks of items; tests/llm/test_round3.py has them.
NOT_BY_DOCUMENT = {"op11_prefix_trie", "op12_ranked_search"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - NOT_BY_DOCUMENT))
def test_registered_queries_return_a_row_for_each_document(spark, small, name):
    rows = queries.QUERIES[name](spark, small)
    ids = [r.doc_id for r in rows.select("doc_id").distinct().collect()]
    assert len(ids) == common.documents(spark, small).count()


def test_pipeline_of_an_empty_table_and_of_odd_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows, kept in (("empty", [], []), ("odd", [(None, "a text", "en", "s", 6), (None, None, "en", "s", 0), (5, "b text", "en", "s", 6), (5, "b text", "en", "s", 6)], [None, None, 5])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        none.write.parquet(f"{folder}/labels.parquet")
        assert sorted((r.doc_id for r in corpus_pipeline.run(spark, folder).collect()), key=lambda x: x or 0) == kept


def test_repeated_ids_are_cut_in_the_order_of_their_digests(spark):
    import hashlib

    from ledgerloom.llm import suffix_dedup

    rng = random.Random(5)
    shared = "".join(rng.choice("abcdef ") for _ in range(150))
    rows = [(None, "x" + shared), (7, shared + "one"), (7, shared + "two"), (7, "three" + shared), (2, shared)]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = cases.cut([(k, t) for k, (_, t) in enumerate(ordered)])
    got = suffix_dedup.dedup_substrings(cases.frame(spark, rows)).collect()
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.kept_sha256) for r in got)
    assert found == sorted((ordered[k][0] is not None, ordered[k][0] or 0, n, removed, sha) for k, n, removed, _, sha in want)
