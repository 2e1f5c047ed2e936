"""Ranked lexical search: sort-based accumulation of integer impacts.

1. The items' terms are the vocabulary, in blocks of bounded size. One pass over the texts counts each document's terms
   and the occurrences of the vocabulary's; words are compared by their bytes, eight at a time. The matches are written.
2. Sums over all documents give N, L and df. Each match has an impact then.
3. A task concatenates, for some documents at a time, the item-document-impact arrays of their matches, sorts packed
   (item, document) keys by radix, adds runs with ``np.add.reduceat``, and keeps each item's best in a heap.
4. The tasks' best are partitioned by ranges of (item, score), cut to the first of each item there, and ranked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby, islice
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, text_or_empty, utf8
from .textblock import ALPHANUMERIC, U64, TextBlock, mixed, text_blocks

BEST = 20
#: Terms of items, item by item, in one block; they and their sums go to every task.
POSTINGS_A_BLOCK = 1_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_LANES = 8


def terms_of(text: Column) -> Column:
    """The terms of a text, repeats included."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


class Vocabulary:
    """Numbers of terms by their bytes. A term of up to eight bytes is its own key; a longer one's key is a hash, and its bytes are compared."""

    def __init__(self, terms: list[bytes]):
        self.terms, self.longest = terms, max(map(len, terms), default=0)
        starts = np.cumsum([0, *(len(t) for t in terms)])[:-1].astype(np.int64)
        lengths = np.array([len(t) for t in terms], np.int64)
        words = _words(np.frombuffer(b"".join(terms), np.uint8))
        self.lengths, self.lanes = lengths, np.stack([_lane(words, starts, lengths, k) for k in range(_LANES)], axis=1) if terms else np.zeros((0, _LANES), U64)
        for self.salt in range(1, 100):
            keys = self._keys(words, starts, lengths)
            self.order = np.argsort(keys)
            self.keys = keys[self.order]
            if (self.keys[1:] != self.keys[:-1]).all():
                return
        raise ValueError("the terms must differ")

    def _keys(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        keys = _lane(words, start, length, 0)
        at = np.flatnonzero(length > 8)
        for k in range(1, -(-self.longest // 8)):
            at = at[length[at] > 8 * k]
            keys[at] = mixed(keys[at] * U64(0x9E3779B97F4A7C15) + _lane(words, start[at], length[at], k) + U64(self.salt))
        return keys

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word's term, or -1."""
        found, length = np.full(len(start), -1, np.int64), end - start
        at = np.flatnonzero(length <= self.longest)
        if not len(at) or not self.terms:
            return found
        words = _words(data)
        keys = self._keys(words, start[at], length[at])
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[place] == keys
        at, term = at[same], self.order[place[same]]
        right = self.lengths[term] == length[at]
        for k in range(_LANES):
            check = np.flatnonzero(right & (length[at] > 8 * max(k, 1)))
            right[check] &= _lane(words, start[at[check]], length[at[check]], k) == self.lanes[term[check], k]
        for i in np.flatnonzero(right & (length[at] > 8 * _LANES)).tolist():
            right[i] = data[start[at[i]] : end[at[i]]].tobytes() == self.terms[term[i]]
        found[at[right]] = term[right]
        return found


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a little-endian number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _lane(words: np.ndarray, start: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of each word, zero past its end."""
    return words[np.minimum(start + 8 * k, len(words) - 1)] & _MASKS[np.clip(length - 8 * k, 0, 8)]


MATCHES = "df boolean, doc_id long, n long, terms array<int>, counts array<int>"


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _matches(vocabulary: list[bytes]):
    """Of rows of ids and texts: terms of each document, and number and occurrences of those that the vocabulary has. At the end,
    as a row with df, the documents of each term in the task."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in MATCHES.split(", ")]
        known, df = Vocabulary(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for first, last, texts in text_blocks(batch.column(1)):
                block = TextBlock(texts, lower=True)
                start, end, doc = block.words(ALPHANUMERIC)
                term = known.find(block.data, start, end)
                hit = term >= 0
                key, counts = np.unique(doc[hit] * len(vocabulary) + term[hit], return_counts=True)
                of, key = (key // len(vocabulary), key % len(vocabulary)) if len(vocabulary) else (key, key)
                df += np.bincount(key, minlength=len(vocabulary))
                n = np.bincount(doc, minlength=len(texts))
                lengths = np.bincount(of, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), bool)), batch.column(0).slice(first, last - first), pa.array(n), _lists(key, lengths), _lists(counts, lengths)], names)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), _lists(used, np.array([len(used)])), _lists(df[used], np.array([len(used)]))], names)

    return made


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The order that sorts keys from 0 to most, 16 bits a pass from the least on (numpy sorts 16-bit numbers by radix)."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while most >> shift:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


FOUND = "item int, doc_id long, score long"


def _scores(documents: int, terms: int, weights: np.ndarray, first: np.ndarray, items: np.ndarray, repeats: np.ndarray, n_items: int, best: int):
    """Of rows of MATCHES: the best documents of each item in the task. first: where each term's postings (items, repeats) begin."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        least = np.zeros(n_items, np.int64)
        step = max(1, 65_536 // n_items)
        for batch in batches:
            lengths, n = batch.column(2).value_lengths().to_numpy(), batch.column(1).to_numpy()
            doc_ids, term, tf = batch.column(0).to_numpy(), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
            m = 75 + 25 * n * documents // terms
            ends = np.cumsum(lengths)
            for a in range(0, batch.num_rows, step):
                b = min(a + step, batch.num_rows)
                own = slice(ends[a] - lengths[a], ends[b - 1])
                doc = np.repeat(np.arange(b - a), lengths[a:b])
                t, count = term[own], tf[own]
                impact = weights[t] * (1_000_000_000 * count // (1000 * count + 12 * m[a:b][doc]))
                many = first[t + 1] - first[t]
                entry = np.repeat(np.arange(len(t)), many)
                posting = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many) + first[t][entry]
                key = items[posting] * (b - a) + doc[entry]
                order = radix_order(key, n_items * (b - a) - 1)
                key = key[order]
                begin = np.flatnonzero(np.diff(key, prepend=-1))
                if not len(begin):
                    continue
                score = np.add.reduceat((impact[entry] * repeats[posting])[order], begin)
                item, of = np.divmod(key[begin], b - a)
                good = np.flatnonzero((score > 0) & (score >= least[item]))
                for i, d, s in zip(item[good].tolist(), doc_ids[a + of[good]].tolist(), score[good].tolist(), strict=True):
                    heap = heaps[i]
                    if len(heap) < best:
                        heapq.heappush(heap, (s, -d))
                    elif (s, -d) > heap[0]:
                        heapq.heapreplace(heap, (s, -d))
                    if len(heap) == best:
                        least[i] = heap[0][0]
        rows = [(i, -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return made


def _first_of_each(best: int):
    """Of rows in the order of their rank: the first so many of each item in the task."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch, i, item) for batch in batches for i, item in enumerate(batch.column(0).to_pylist()))
        for _, own in groupby(rows, key=lambda x: x[2]):
            for batch, i, _ in islice(own, best):
                yield batch.slice(i, 1)

    return made


def ranked_search(docs: DataFrame, items: DataFrame, best: int = BEST, postings_a_block: int = POSTINGS_A_BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents (doc_id, text) of each item (item_id, text).

    Terms are maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. Scores are
    the 64-bit integers of the module's contract; equal scores rank by ascending doc_id. A null text has no terms; items
    without terms, or none of whose terms any document has, have no rows. Rows of items with equal ids are one item with
    the terms of its different texts. Documents that repeat an id are ranked each; those without an id count in the
    statistics and are not ranked. Empty tables give an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("utf8"))
    own = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).distinct()
    own = own.select("item_id", F.explode(terms_of(F.col("text"))).alias("term"))
    postings = cut_lineage(own.groupBy("item_id", "term").agg(F.count("*").alias("repeats")), "postings")
    blocks = max(1, -(-postings.count() // postings_a_block))
    found = None
    for block in range(blocks):
        part = postings.where(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {block}"))
        rows = part.orderBy("term", "item_id").collect()  # a block, which postings_a_block bounds
        one = _block(texts, rows, best)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _block(texts: DataFrame, rows: list, best: int) -> DataFrame:
    """item_id, doc_id and score of some best documents, among them all that rank, of the items of one block of postings."""
    spark = texts.sparkSession
    terms = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    names = sorted({r["item_id"] for r in rows}, key=lambda i: (i is not None, i))
    item_of = {x: i for i, x in enumerate(names)}
    matches = cut_lineage(texts.mapInArrow(_matches([t.encode() for t in terms]), MATCHES), "matches")
    documents, total = matches.where("not df and n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = matches.where("df").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    weights = np.zeros(len(terms), np.int64)
    for r in held.collect():  # a row for each term of the block at most
        weights[r["terms"]] = floor(1000 * log((2 * documents + 2) / (2 * r["df"] + 1)))
    term = np.array([number[r["term"]] for r in rows], np.int64)
    first = np.searchsorted(term[(by := np.argsort(term, kind="stable"))], np.arange(len(terms) + 1))
    item = np.array([item_of[r["item_id"]] for r in rows], np.int64)[by]
    repeats = np.array([r["repeats"] for r in rows], np.int64)[by]
    ids = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
    ranked = matches.where("not df and doc_id is not null and size(terms) > 0").select("doc_id", "n", "terms", "counts")
    found = ranked.mapInArrow(_scores(documents, max(total, 1), weights, first, item, repeats, max(len(names), 1), best), FOUND)
    found = found.repartitionByRange("item", F.desc("score"), "doc_id").sortWithinPartitions("item", F.desc("score"), "doc_id")
    return found.mapInArrow(_first_of_each(best), FOUND).join(ids, "item").select("item_id", "doc_id", "score")


ORACLE_SQL = rf"""
WITH found AS (
  SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents
), sized AS (
  SELECT nth, doc_id, len(terms)::BIGINT AS n, terms FROM found WHERE len(terms) > 0
), sums AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sized
), items AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term
        FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark))
  GROUP BY item_id, term
), counted AS (
  SELECT nth, doc_id, n, term, count(*) AS tf
  FROM (SELECT nth, doc_id, n, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM items) GROUP BY nth, doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, sums GROUP BY term
), scored AS (
  SELECT i.item_id, c.nth, c.doc_id,
         sum(i.repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM counted c JOIN items i USING (term) JOIN weights USING (term), sums GROUP BY i.item_id, c.nth, c.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 AND doc_id IS NOT NULL
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
