"""Packing, token files and sentencepiece against the tokenizers' own libraries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import packing, sentencepiece_scan, token_files, tokens
from tests.llm import cases

MIXED = st.text(st.sampled_from(list("abcXYZ é漢Ωıİß'.,!?;$#*|0189\n\t\r   ́_-<>\x1c")), max_size=60)
ODD_WORDS = st.lists(st.sampled_from(["Foo", "foo's", "don't.", "x...", "é.", "é.", "«é»,", "a\nB", "a.\nB,", "1,5", "<|endoftext|>", "THE", "İx", "a\x00."]), max_size=12).map(" ".join)


@pytest.mark.parametrize(("name", "keeps"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_words_encode_as_the_library_encodes_the_whole_text(name, keeps):
    coder = tokens.WordCoder(tokens.vocabulary_path(name), keeps)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(MIXED | ODD_WORDS, max_size=4))
    def holds(texts):
        data = [t.encode() for t in texts]
        assert coder.encode(data) == coder.library(data)

    holds()
    data = [(t or "").encode() for _, t in cases.ODD + cases.shared_passages(1)]
    assert coder.encode(data) == coder.library(data)


@pytest.mark.parametrize(("name", "keeps"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_added_tokens_encode_as_by_an_untouched_tokenizer(name, keeps):
    from tokenizers import Tokenizer

    coder, untouched = tokens.WordCoder(tokens.vocabulary_path(name), keeps), Tokenizer.from_file(tokens.vocabulary_path(name))
    want = lambda texts: [tokens.as_bytes(untouched.encode(t, add_special_tokens=False).ids) for t in texts]
    names = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", "<"]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(names) | MIXED | ODD_WORDS, max_size=6).map("".join), max_size=4))
    def holds(texts):
        assert coder.encode([t.encode() for t in texts]) == want(texts)

    holds()
    texts = ["end of file <|endoftext|> next", "a<|startoftext|>b", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> x <|endoftext|>\n\ny", "e<|endoftext|>́"]
    assert coder.encode([t.encode() for t in texts]) == want(texts)
    if keeps:
        assert np.frombuffer(coder.encode([texts[0].encode()])[0], "<u4").tolist() == [437, 286, 2393, 220, 50256, 1306]


@pytest.mark.parametrize("name, keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_words_are_held_in_few_bytes_and_long_texts_in_parts(monkeypatch, name, keeps):
    coder = tokens.WordCoder(tokens.vocabulary_path(name), keeps)
    texts = [b" ".join(b"word%d, x%dy" % (i, i * i) for i in range(k, k + 4_000)) for k in (0, 4_000)]
    assert coder.encode(texts) == coder.library(texts)
    held = [len(s[0]) for s in coder.known]
    assert sum(held) >= 16_000 and len(held) < 12
    assert sum(x.nbytes for s in coder.known for x in s) < 50 * sum(held)
    monkeypatch.setattr(tokens, "TEXT_BYTES", 1_000)
    more = [t.replace(b"word", b"\nword") + b"  end\n" for t in texts] + [b"", b" a \n b", b"\n\nx "]
    assert coder.encode(more) == coder.library(more)


def test_a_full_cache_starts_anew():
    coder = tokens.WordCoder(tokens.vocabulary_path("word_bpe_49k.json"), False)
    coder.most = 3
    for text in (b"one two three four", b"five six", b"one two"):
        assert coder.encode([text]) == coder.library([text])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_best_fit_and_its_bound(lengths):
    lengths = np.array(lengths, np.int64)
    bins, room = packing.best_fit_decreasing(lengths, 50)
    filled = np.bincount(bins, lengths, len(room)) if len(lengths) else np.zeros(0)
    assert (filled + room == 50).all() and (room >= 0).all()
    assert packing.lower_bound(lengths, 50) <= len(room)


def test_bound_sees_items_that_cannot_share():
    assert packing.lower_bound(np.array([26, 26, 26]), 50) == 3
    assert packing.lower_bound(np.array([17] * 6), 50) == 3


@pytest.mark.parametrize("a_partition", [20_000, 10])
def test_packing_places_every_piece_once(spark, a_partition):
    rows = cases.near_copies(1) + [(2000, "word " * 9000)]
    got = packing.pack(cases.frame(spark, rows), pieces_a_partition=a_partition).collect()
    coder = tokens.WordCoder(tokens.vocabulary_path("word_bpe_49k.json"), False)
    want = []
    for i, text in rows:
        ids = np.r_[np.frombuffer(coder.library([(text or "").encode()])[0], "<u4"), [1]].astype("<u4")
        want += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 4096
    assert len(sequences) <= -(-sum(r.length for r in got) // 4096) + (4 if a_partition < 100 else 1)


def test_packing_of_an_empty_table(spark):
    assert packing.pack(cases.frame(spark, [(1, "a")]).limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_variable_length_codes_round_trip(ranks):
    ranks = np.array(ranks, np.uint32)
    control, data = token_files.encode_ranks(ranks)
    assert len(control) == -(-len(ranks) // 4)
    assert token_files.decode_ranks(control, data, len(ranks)).tolist() == ranks.tolist()


@pytest.mark.parametrize("a_block", [500_000, 50])
def test_token_files_give_back_the_ids(spark, tmp_path, a_block):
    rows = cases.ODD + cases.near_copies(2)[:40] + [(3, "again"), (3, "before")]
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(cases.frame(spark, rows), path, ids_a_block=a_block)
    coder = tokens.WordCoder(tokens.vocabulary_path("byte_bpe_50k.json"), True)
    ids = [(i, np.r_[np.frombuffer(coder.library([(t or "").encode()])[0], "<u4"), [2]].astype("<u4")) for i, t in sorted(rows, key=lambda r: (r[0], r[1] or ""))]
    starts = np.cumsum([0, *(len(x) for _, x in ids)])
    want = [(i, int(s), len(x), zlib.crc32(x.tobytes())) for (i, x), s in zip(ids, starts)]
    assert sorted(tuple(r) for r in token_files.digest_token_files(spark, path).collect()) == sorted(want)
    back = sorted((r.doc_id, r.ids) for r in token_files.read_token_files(spark, path).collect())
    assert back == sorted((i, x.tolist()) for i, x in ids)
    ranks = {r.id: r.rank for r in spark.read.parquet(f"{path}/ranks").collect()}
    counts = np.bincount(np.concatenate([x for _, x in ids]))
    assert sorted(ranks, key=ranks.get) == sorted(ranks, key=lambda i: (-counts[i], i))


def test_token_files_of_an_empty_table(spark):
    assert token_files.token_files(cases.frame(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 40, 8192])
def test_scan_over_chunks_equals_the_library(chunk):
    pieces, rng = sentencepiece_scan.model(tokens.vocabulary_path("piece_bpe_32k.model")), random.Random(0)
    texts = ["".join(rng.choice(list("ab c▁dé漢\n\t\x00Ω") + ["the ", "ing", "  "]) for _ in range(80)) for _ in range(20)]
    texts += ["a", " ", "    x", "a" * 60, "hello" * 20, "", "many plain words in a row, as in prose. " * 5]
    for text in texts:
        s = sentencepiece_scan._normalized(text)
        bounds = [(k, min(k + chunk, len(s))) for k in range(0, len(s), chunk)]
        found = sentencepiece_scan.states([sentencepiece_scan.transfer(pieces, s, a, b) for a, b in bounds])
        traced = [sentencepiece_scan.backtrace(pieces, s, a, b, x, y) for (a, b), x, y in zip(bounds, found, found[1:])]
        assert [i for part in traced for p in part for i in pieces.ids_of(p)] == pieces.library.encode(text)
    for text, (n, ids) in zip(texts, sentencepiece_scan.scan(pieces, texts, chunk)):
        assert np.frombuffer(ids, "<u4").tolist() == pieces.library.encode(text)
        assert n == -(-len(sentencepiece_scan._normalized(text)) // chunk)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "  ", "▁", "ing", "é", "漢", "\n", "x", "Hello", "unbelievable", "\x00", "🙂"]), max_size=40).map("".join), st.integers(1, 30))
def test_any_text_and_chunk_gives_the_librarys_ids(text, chunk):
    pieces = sentencepiece_scan.model(tokens.vocabulary_path("piece_bpe_32k.model"))
    ((n, ids),) = sentencepiece_scan.scan(pieces, [text], chunk)
    assert np.frombuffer(ids, "<u4").tolist() == pieces.library.encode(text)
    assert n == -(-len(sentencepiece_scan._normalized(text)) // chunk)


def test_a_full_store_of_words_starts_anew(monkeypatch):
    pieces = sentencepiece_scan.Pieces(tokens.vocabulary_path("piece_bpe_32k.model"))
    monkeypatch.setattr(sentencepiece_scan, "WORDS", 3)
    for text in ("one two three four", "five six one", "one two"):
        assert np.frombuffer(sentencepiece_scan.scan(pieces, [text])[0][1], "<u4").tolist() == pieces.library.encode(text)


@pytest.mark.parametrize("lost", [False, True])
def test_sentencepiece_encodes_in_chunks_and_decodes(spark, monkeypatch, lost):
    """lost: no document's states are found, so that all go to the library."""
    if lost:
        monkeypatch.setattr(sentencepiece_scan, "_scanned", lambda rows: rows[["digest", "k"]].assign(edges=None))
    rows = cases.near_copies(3)[:60] + cases.ODD + [(5000, "word " * 3000), (5001, "word " * 3000), (None, "x"), (3, "again")]
    encoded = sentencepiece_scan.encode(cases.frame(spark, rows), spread=4, chunk=300)
    library = sentencepiece_scan.model(tokens.vocabulary_path("piece_bpe_32k.model")).library
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect()), key=repr)
    assert got == sorted(((i, library.encode(t or "")) for i, t in rows), key=repr)
    back = sorted(((r.doc_id, r.text) for r in sentencepiece_scan.decode(encoded).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in rows), key=repr)
    assert encoded.where("chunks > 1").count() >= 2
    assert sentencepiece_scan.encode(cases.frame(spark, rows).limit(0)).count() == 0


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    rows = [(None, "one two"), (None, None), (3, "again"), (3, "again"), (3, "other")]
    packed = packing.pack(cases.frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start) for r in packed) == [(False, 3, 0, 0)] * 3 + [(True, 0, 0, 0)] * 2
    files = token_files.token_files(cases.frame(spark, rows)).orderBy("start").collect()
    assert [r.doc_id for r in files] == [None, None, 3, 3, 3] and [r.start for r in files] == np.cumsum([0, *(r.n_tokens for r in files)]).tolist()[:-1]


def test_rows_without_an_id_are_dealt_over_the_tasks(spark):
    """Half of the rows lack an id; no task may take them all, and what is read back is whole."""
    from pyspark.sql import functions as F

    docs = spark.range(4_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" text")).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = token_files._tokenized(docs, tokens.vocabulary_path("byte_bpe_50k.json"), True, 2, 500).where("block >= 0").groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(r.n for r in blocks) == 4_000 and max(r.n for r in blocks) < 1_700
