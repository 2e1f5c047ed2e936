"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, found with a block-max inverted index.

Terms are all lower-cased words of a bounded sample of labelled documents (``SAMPLE`` of each class), the examples.
A term weighs (1 + log count) * idf * telling: inverse document frequencies count all documents, and telling is 1, or
z * z / 4 for terms whose log-odds differ between the classes by more than z = 2 standard errors. So no term is left
out, and those that tell the classes apart weigh the more. Every document becomes its vector over its whole text
and looks up its nearest examples: postings lie in blocks of examples, each with its greatest weight per term. The postings
of the commonest terms, which reach nearly every block, lie as rows of a matrix and are summed first by a product; the
greatest sum in a block goes into its upper bound. A batch of documents then reads the blocks of the highest upper
bounds, then every block whose bound reaches the cosine of the last neighbour found; so cosines and neighbours are exact.

A neighbour's vote weighs its cosine times its class's share in all labelled rows over its share in the sample;
``PRIOR`` votes for the classes' shares smooth the toxic share. A logistic curve turns shares into scores; it is fitted
to the examples' own toxic shares, each by neighbours and weights of the other ``FOLDS`` - 1 parts of the examples. Texts without any term score as the labelled
texts without any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, utf8
from .labelled import held_out, sample
from .quality_classifier import logistic
from .textblock import ALPHANUMERIC, U64, TextBlock, text_blocks

SAMPLE = 1_500
NEIGHBOURS = 15
EVIDENCE = 3
PRIOR = 0.2
FOLDS = 5
BLOCK = 64
THRESHOLD = 0.5
ROWS_A_TASK = 5_000
#: Postings of the terms of the documents that are looked up at once (one document at least), and the blocks that each reads first.
POSTINGS = 1_500_000
FIRST_BLOCKS = 4
#: Terms whose postings lie as rows of a matrix at most, and the share of the examples that has such a term at least.
COMMON = 512
COMMON_SHARE = 1 / 32


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and count of each distinct lower-cased word of each text, ordered by text number and hash."""
    block = TextBlock(texts, lower=True)
    start, end, doc = block.words(ALPHANUMERIC)
    h = block.hashes(start, end)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)])
    return h[first], doc[first], np.diff(np.r_[first, len(h)])


def _lists(doc: np.ndarray, texts: int, *columns: pa.Array) -> list[pa.Array]:
    ends = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=texts))].astype(np.int32))
    return [pa.ListArray.from_arrays(ends, c) for c in columns]


def _flat(batch: pa.RecordBatch | pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and how many each row has."""
    lists = batch[column].combine_chunks() if isinstance(batch, pa.Table) else batch[column]
    return np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets)).astype(np.int64)


def _examples(rows: DataFrame) -> pa.Table:
    """doc_id, label and the hashes and counts of the terms of each example, in the order of doc_id; the sample bounds it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in text_blocks(batch.column(2)):
                h, doc, count = terms(texts)
                lists = _lists(doc, len(texts), pa.array(h.view(np.int64)), pa.array(count.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[first:last] for c in (0, 1)), *lists], ["doc_id", "label", "terms", "counts"])

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "utf8")
    return rows.mapInArrow(found, "doc_id long, label int, terms array<long>, counts array<int>").toArrow().sort_by("doc_id")


def _vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, held_out, and the numbers and counts of the vocabulary's terms in each text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # eight bytes for each distinct word of the examples
    mask = U64((1 << 22) - 1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(known & mask).astype(np.int64)] = True
        for batch in batches:
            for first, last, texts in text_blocks(batch.column(2)):
                h, doc, count = terms(texts)
                some = np.flatnonzero(maybe[(h & mask).astype(np.int64)])
                at = np.searchsorted(known, h[some])
                own = known[np.minimum(at, len(known) - 1)] == h[some] if len(known) else np.zeros(0, bool)
                some, at = some[own] if len(known) else some[:0], at[own] if len(known) else at[:0]
                lists = _lists(doc[some], len(texts), pa.array(at.astype(np.int32)), pa.array(count[some].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[first:last] for c in (0, 1)), *lists], ["doc_id", "held_out", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(), utf8())
    return rows.mapInArrow(found, "doc_id long, held_out boolean, terms array<int>, counts array<int>")


def _document_frequencies(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents have each term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch["terms"].flatten()), minlength=n_terms)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(total[term])], ["term", "n"])

    sums = vectors.select("terms").mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(n_terms)
    df[np.asarray(sums["term"])] = np.asarray(sums["n"])  # a row for each term of the examples at most
    return df


def telling(term: np.ndarray, row: np.ndarray, y: np.ndarray, n_terms: int) -> np.ndarray:
    """Per term max(1, z * z / 4), z the log-odds between the classes in standard errors, by the examples that have it."""
    a = np.bincount(term, y[row], n_terms) + 0.5
    b = np.bincount(term, 1 - y[row], n_terms) + 0.5
    not_a, not_b = (y == 1).sum() + 1 - a, (y == 0).sum() + 1 - b
    z = np.log(a * not_b / (b * not_a)) / np.sqrt(1 / a + 1 / b + 1 / not_a + 1 / not_b)
    return np.maximum(1.0, z * z / 4)


class BlockMaxIndex:
    """Examples' unit vectors as postings by term and block of examples (slots), each with its greatest weight."""

    def __init__(self, ids: np.ndarray, term: np.ndarray, row: np.ndarray, weight: np.ndarray, n_terms: int, block: int = BLOCK):
        """term, row, weight: of the examples' vectors; row: the number of the example in ids."""
        # Examples with the same leading term lie together, which keeps the blocks' upper bounds low.
        by = np.lexsort((-weight, row))
        leads = by[np.unique(row[by], return_index=True)[1]] if len(by) else by
        lead = np.full(len(ids), n_terms)
        lead[row[leads]] = term[leads]
        self.order = np.lexsort((ids, lead))
        self.ids, self.block = ids[self.order], block
        self.blocks = max(-(-len(ids) // block), 1)
        place = np.empty(len(ids), np.int64)
        place[self.order] = np.arange(len(ids))
        at = place[row]
        counts = np.bincount(term, minlength=n_terms)
        common = np.argsort(-counts, kind="stable")[:COMMON]
        common = common[counts[common] > max(COMMON_SHARE * len(ids), 1)]
        self.column = np.full(n_terms, -1, np.int32)  # of a term in the matrix
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.blocks * block))
        held = self.column[term] >= 0
        self.matrix[self.column[term[held]], at[held]] = weight[held]
        term, at, weight = term[~held], at[~held], weight[~held]
        by = np.lexsort((at, term))
        term, self.row, self.weight = term[by], at[by].astype(np.int32), weight[by]
        slot = term.astype(np.int64) * self.blocks + self.row // block
        start = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][: len(slot)])
        self.first = np.r_[start, len(slot)].astype(np.int32)  # of a slot's postings
        self.slot_block = (slot[start] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else self.weight
        self.slots = np.searchsorted(slot[start] // self.blocks, np.arange(n_terms + 1)).astype(np.int32)  # of a term

    def nearest(self, term: np.ndarray, weight: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, row and cosine of each query's k nearest examples with a cosine over 0, the nearest first.

        term and weight hold the queries' unit vectors one after another, of the given lengths. Of equal cosines (to
        nine places) the smaller id is nearer.
        """
        parts, ends = [], np.r_[0, np.cumsum(lengths)]
        held = np.r_[0, np.cumsum(self.first[self.slots[term + 1]] - self.first[self.slots[term]], dtype=np.int64)][ends]
        a = 0
        while a < len(lengths):
            b = max(int(np.searchsorted(held, held[a] + POSTINGS, "right")) - 1, a + 1)
            b = min(b, a + POSTINGS // (self.blocks * self.block) + 1)
            q, row, cosine = self._nearest(term[ends[a] : ends[b]], weight[ends[a] : ends[b]], lengths[a:b], k)
            parts.append((q + a, row, cosine))
            a = b
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _nearest(self, term: np.ndarray, weight: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, width = len(lengths), self.blocks * self.block
        query, column = np.repeat(np.arange(n), lengths), self.column[term]
        common = np.flatnonzero(column >= 0)
        dense = np.zeros((n, len(self.matrix)))
        dense[query[common], column[common]] = weight[common]
        dots = (dense @ self.matrix).ravel()
        slot, of = _ranges(self.slots[term], self.slots[term + 1])
        query, weight = query[of], weight[of]
        cell = query * self.blocks + self.slot_block[slot]
        bound = dots.reshape(n, self.blocks, self.block).max(axis=2)
        bound += np.bincount(cell, weight * self.most[slot], n * self.blocks).reshape(n, self.blocks)
        early = np.zeros((n, self.blocks), bool)
        first = min(FIRST_BLOCKS, self.blocks)
        np.put_along_axis(early, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        least = np.zeros(n)
        for turn in range(2):
            todo = early if turn == 0 else ~early & (bound >= least[:, None] - 1e-9) & (bound > 0)
            some = np.flatnonzero(todo.ravel()[cell])
            posting, which = _ranges(self.first[slot[some]], self.first[slot[some] + 1])
            some = some[which]
            dots += np.bincount(query[some] * width + self.row[posting], weight[some] * self.weight[posting], n * width)
            if turn == 0 and k < width:
                least = np.maximum(np.partition(dots.reshape(n, width), width - k, axis=1)[:, width - k], 0)
        dots = np.round(dots, 12).reshape(n, width)
        last = np.partition(dots, width - k, axis=1)[:, width - k] if k < width else np.zeros(n)
        q, row = np.nonzero((dots > 0) & (dots >= last[:, None] - 1e-9))
        cosine = dots[q, row]
        by = np.lexsort((self.ids[row], -np.round(cosine, 9), q))
        q, row, cosine = q[by], row[by], cosine[by]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        return q[nth < k], row[nth < k], cosine[nth < k]


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and of which range each is."""
    n = (end - start).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + np.repeat(start - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n), of


class Voter:
    """Scores vectors by the votes of their nearest examples, whose vectors are given one after another."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, term: np.ndarray, count: np.ndarray, lengths: np.ndarray, idf: np.ndarray, whole: dict[int, int]):
        row = np.repeat(np.arange(len(ids)), lengths)
        self.factor = idf * telling(term, row, y, len(idf))
        self.index = BlockMaxIndex(ids, term, row, self.unit(term, count, lengths), len(idf))
        self.y = y[self.index.order]
        share = {c: whole.get(c, 0) / max((y == c).sum(), 1) for c in (0, 1)}
        weights = np.where(y == 1, share[1], share[0]).astype(float)
        self.vote = (weights / max(weights.mean(), 1e-12) if len(y) else weights)[self.index.order]
        self.prior = (whole.get(1, 0) + 1) / (whole.get(1, 0) + whole.get(0, 0) + 2)
        none = lengths == 0
        self.without = float((weights[none & (y == 1)].sum() + self.prior) / (weights[none].sum() + 1))
        self.slope, self.offset = None, 0.0
        fold, shares = np.arange(len(ids)) % FOLDS, np.zeros(len(ids))
        if whole and min((y[fold != k] == c).sum() for k in range(FOLDS) for c in (0, 1)) > 0:
            for k in range(FOLDS):
                rest, own = fold != k, fold == k
                others = Voter(ids[rest], y[rest], term[rest[row]], count[rest[row]], lengths[rest], idf, {})
                others.vote, others.prior = (weights / weights.mean())[rest][others.index.order], self.prior
                shares[own] = others.score(term[own[row]], count[own[row]], lengths[own])[0]
            y, shares, weights = y[~none], shares[~none], weights[~none]
            self.slope, self.offset = logistic(shares, np.where(y == 1, 1, -1), weights / weights.mean())

    def unit(self, term: np.ndarray, count: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.factor[term]
        of = np.repeat(np.arange(len(lengths)), lengths)
        norm = np.sqrt(np.bincount(of, w * w, len(lengths)))
        return w / norm[of]

    def score(self, term: np.ndarray, count: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The scores, and query, row and cosine of the nearest examples."""
        q, near, cosine = self.index.nearest(term, self.unit(term, count, lengths), lengths, NEIGHBOURS)
        votes, n = cosine * self.vote[near], len(lengths)
        shares = (np.bincount(q, votes * self.y[near], n) + PRIOR * self.prior) / (np.bincount(q, votes, n) + PRIOR)
        if self.slope is not None:
            shares = 1 / (1 + np.exp(-np.clip(self.slope * shares + self.offset, -30, 30)))
        return np.where(lengths > 0, shares, self.without), (q, near, cosine)


SCHEMA = "doc_id long, held_out boolean, score double, evidence array<struct<doc_id:long,toxic:int,cosine:double>>"


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (nearest labelled examples) of each row of docs.

    A null, empty or word-less text has no neighbours and scores as the labelled texts without terms. Without labels of
    both classes every score is the smoothed share of toxic rows. Rows that repeat score alike; a null doc_id is
    passed on; an empty table gives an empty table; labels, lang, source and doc_id are no input of a score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    drawn, whole = sample(labels.select("doc_id", F.col("toxic").alias("label")), "label", most)
    # The sample has 2 * most rows at most, whatever the input.
    held = _examples(docs.select("doc_id", utf8().alias("utf8")).join(F.broadcast(drawn), "doc_id"))
    hashes, lengths = _flat(held, "terms")
    vocabulary, term = np.unique(hashes.view(U64), return_inverse=True)
    vectors = cut_lineage(_vectors(docs, vocabulary), "term-vectors")
    n = vectors.count()
    idf = np.log((n + 1) / (_document_frequencies(vectors, len(vocabulary)) + 1)) + 1
    voter = Voter(np.asarray(held["doc_id"]), np.asarray(held["label"]).astype(np.int64), term, _flat(held, "counts")[0], lengths, idf, whole)
    shared = spark.sparkContext.broadcast(voter)  # bounded by the sample

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, lengths = _flat(batch, "terms")
            scores, (q, near, cosine) = shared.value.score(term, _flat(batch, "counts")[0], lengths)
            shown = np.arange(len(q)) - np.searchsorted(q, q) < EVIDENCE
            q, near, cosine = q[shown], near[shown], cosine[shown]
            of = [pa.array(shared.value.index.ids[near]), pa.array(shared.value.y[near].astype(np.int32)), pa.array(cosine)]
            evidence = _lists(q, batch.num_rows, pa.StructArray.from_arrays(of, ["doc_id", "toxic", "cosine"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), *evidence], ["doc_id", "held_out", "score", "evidence"])

    # The vectors are small in bytes but dear in work, so their rows say how many tasks they need.
    dealt = vectors.repartition(max(1, n // ROWS_A_TASK))
    return dealt.mapInArrow(scored, SCHEMA).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
