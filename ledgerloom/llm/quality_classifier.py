"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log-count ratios of the two classes and scaled to unit length per text; a
linear hinge-loss model is fitted to them by dual coordinate descent, and a logistic curve through held-back margins
turns margins into scores. The n-grams are word unigrams and bigrams (lower-cased) and runs of one to three word
shapes: letter case, marks around the letters, and whether the word repeats the one before. All share one hashed space.

Only the bounded sample of labelled rows (``SAMPLE`` of each class) reaches the driver, as hashed n-grams; every
document is scored on the executors, over its whole text, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8
from .labelled import held_out, sample
from .textblock import NOT_WHITE, U64, TextBlock, mixed, sequences, text_blocks

SAMPLE = 2_000
BITS = 18
LEAST_TEXTS = 5
COST = 1.0
PASSES = 12
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _MARK = 1, 2, 4, 8
_KIND = np.array(
    [_LOWER if b >= 0x80 or 97 <= b <= 122 else _UPPER if 65 <= b <= 90 else _DIGIT if 48 <= b <= 57 else _MARK for b in range(256)],
    np.uint8,
)


def _capped(x: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(x, most).astype(U64)


def shapes(block: TextBlock, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A number for each word: its first and last kinds of character, its marks, case, length and repetition."""
    kind = _KIND[block.data]
    count = lambda k: np.add.reduceat(kind == k, start, dtype=np.int32) if len(start) else start
    # The bytes up to the next word are white space, which counts as marks, so those are counted from the length.
    upper, lower, digit = count(_UPPER), count(_LOWER), count(_DIGIT)
    marks = (end - start) - upper - lower - digit
    same = np.zeros(len(start), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    shape = _capped(upper, 2)
    for x, most in ((lower, 1), (digit, 1), (marks, 3), (same, 1), ((end - start) // 12, 2)):
        shape = shape * U64(most + 1) + _capped(x, most)
    last = block.data[np.maximum(end - 1, 0)].astype(U64) if len(end) else np.zeros(0, U64)
    return shape * U64(256) + np.where(marks > 0, last, U64(0))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hashed n-gram of each distinct n-gram of each text, ordered by both."""
    exact, block = TextBlock(texts), TextBlock(texts, lower=True)
    start, end, doc = exact.words(NOT_WHITE)
    words = block.hashes(start, end)
    shape = mixed(shapes(exact, start, end, words, doc) + U64(1))
    streams = [(words, doc)] + [sequences(words, doc, 2), (shape, doc), sequences(shape, doc, 2), sequences(shape, doc, 3)]
    keys = [(d.astype(U64) << U64(BITS)) | (mixed(h ^ U64(k)) >> U64(64 - BITS)) for k, (h, d) in enumerate(streams)]
    keys = np.unique(np.concatenate(keys))
    return (keys >> U64(BITS)).astype(np.int64), (keys & U64((1 << BITS) - 1)).astype(np.int64)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Per n-gram, the log of its smoothed share among the n-grams of class 1 over that of class 0; 0 for rare ones."""
    counts = [np.bincount(np.concatenate([x for x, c in zip(rows, y, strict=True) if c == k] or [np.zeros(0, np.int64)]), minlength=1 << BITS) for k in (1, -1)]
    common = counts[0] + counts[1] >= LEAST_TEXTS
    p, q = (1.0 + c for c in counts)
    return np.where(common, np.log(p / p[common].sum() / (q / q[common].sum())), 0.0) if common.any() else np.zeros(1 << BITS)


def dual_coordinate_descent(rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, cost: float, passes: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * (hinge losses), one dual variable, from 0 to its cost, at a time.

    A class's losses count in inverse proportion to its rows.
    """
    values = [_unit(ratios[x]) for x in rows]
    share = {k: len(y) / 2 / max((y == k).sum(), 1) for k in (1, -1)}
    most = np.array([cost * share[k] for k in y])
    norms = np.array([v @ v for v in values]) + 1  # 1: the bias's constant feature
    w, bias, alpha, order = np.zeros(1 << BITS), 0.0, np.zeros(len(y)), np.random.default_rng(0)
    for _ in range(passes):
        for i in order.permutation(len(y)):
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.sqrt(v @ v) or 1.0)


def logistic(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, passes: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins (labels 1 and -1), by Newton's method."""
    a, b, t = 1.0, 0.0, (y > 0) * 0.98 + 0.01
    for _ in range(passes):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        hess = np.array([[h @ margins**2 + 1e-6, h @ margins], [h @ margins, h.sum()]])
        step = np.linalg.solve(hess, [g @ margins + 1e-6 * a, g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    """score = 1 / (1 + exp(-(slope * (w.x + bias) + offset))), x the unit-length scaled indicators of a text."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, whole: dict[int, int]):
        """whole: rows of each class in all labelled rows, which weigh the classes of the sample when calibrating."""
        self.ratios, self.weights, self.bias, self.slope, self.offset = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 0.0, 0.0
        p = (whole.get(1, 0) + 1) / (whole.get(1, 0) + whole.get(0, 0) + 2)
        self.offset = float(np.log(p / (1 - p)))
        if len(set(y.tolist())) < 2:
            return
        fold, margins = np.arange(len(y)) % 3, np.zeros(len(y))
        for k in range(3):
            learn, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            own = [rows[i] for i in learn]
            ratios = log_count_ratios(own, y[learn])
            w, bias = dual_coordinate_descent(own, ratios, y[learn], COST, PASSES)
            margins[rest] = [w[rows[i]] @ _unit(ratios[rows[i]]) + bias for i in rest]
        weight = np.array([whole.get(int(k > 0), 1) / (y == k).sum() for k in y])
        self.slope, self.offset = logistic(margins, y, weight / weight.mean())
        ratios = log_count_ratios(rows, y)
        w, self.bias = dual_coordinate_descent(rows, ratios, y, COST, PASSES)
        self.ratios, self.weights = ratios.astype(np.float32), (w * ratios).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        doc, gram = features(texts)
        dot = np.bincount(doc, self.weights[gram], len(texts))
        norm = np.sqrt(np.bincount(doc, self.ratios[gram].astype(np.float64) ** 2, len(texts)))
        margin = np.divide(dot, norm, out=np.zeros(len(texts)), where=norm > 0) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Learns from at most ``most`` labelled documents of each class outside the held-out fold."""
    small_batches(docs.sparkSession)
    drawn, whole = sample(labels.select("doc_id", F.col("quality").alias("label")), "label", most)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in text_blocks(batch.column(2)):
                doc, gram = features(texts)
                ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[first:last] for c in (0, 1)), lists], ["doc_id", "label", "grams"])

    # The sample has 2 * most rows at most, whatever the input.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("utf8")).join(F.broadcast(drawn), "doc_id")
    rows = rows.select("doc_id", "label", "utf8").mapInArrow(grams, "doc_id long, label int, grams array<int>").toArrow().sort_by("doc_id")
    offsets = rows["grams"].combine_chunks()
    values, ends = np.asarray(offsets.flatten()), np.asarray(offsets.offsets) - (offsets.offsets[0].as_py() if len(rows) else 0)
    y = np.where(np.asarray(rows["label"]) == 1, 1, -1)
    return Model([values[a:b].astype(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)], y, whole)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    A null or empty text has no n-grams and scores by the bias alone. Without labels of both classes every score is the
    smoothed share of class 1. Rows that repeat score alike; a null doc_id is passed on; other columns are no input.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in text_blocks(batch.column(2)):
                own = [batch.column(c)[first:last] for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(shared.value.scores(texts))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(), utf8())
    rows = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in text_blocks(batch.column(batch.num_columns - 1)):
                rows = batch.slice(first, last - first).filter(pa.array(shared.value.scores(texts) >= threshold))
                yield pa.RecordBatch.from_arrays(rows.columns[:-1], rows.schema.names[:-1])

    return docs.withColumn("__utf8", utf8()).mapInArrow(kept, docs.schema)
