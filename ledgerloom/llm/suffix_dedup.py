"""Suffix-array dedup: removes each byte covered by a string of ``LENGTH`` bytes that also starts earlier.

Inserting one symbol of every document a round takes as many rounds as the longest document has bytes, each over the
whole collection. So the column-wise construction runs on short segments that hold every repeated string:

1. Texts equal to a text of a smaller id are covered whole, and only the first ones go on.
2. Every window of LENGTH bytes names an anchor, the least hash of its GRAM-byte grams (a minimizer). Equal windows have
   equal anchors at equal distances, so windows can only repeat among the occurrences of one anchor.
3. Occurrences of an anchor that is met twice or more become segments: the bytes that the windows naming it span,
   aligned at the anchor. Windows of different segments can only be equal in the same column.
4. The segments of an anchor are sorted column by column from the right: each round inserts one symbol of every segment
   in front of its suffix, which updates the order of the suffixes (the aligned case of the collection's
   Burrows-Wheeler transform) and the common prefixes of neighbours. In a column, suffixes with common prefixes of
   LENGTH or more hold the same window, and all but the earliest are covered.
5. Covered bytes are joined to runs per document.

Of an anchor's segments that are equal throughout, by 95 bits of a hash whose key each run draws anew, only the first is
cut out and sorted; the others are covered whole. Windows of segments are compared by their bytes. Anchors with more than ``SEGMENTS`` different
segments are settled by grouping their windows themselves, on Spark. Nothing is written outside Spark: the rounds' order and prefixes take
a few bytes per segment and stay in the task's memory instead of external files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, utf8
from .textblock import U64, TextBlock, mixed, new_key, text_blocks

LENGTH = 100
GRAM = 24
SEGMENTS = 5_000
#: Segments that are sorted at once.
BATCH = 20_000
_BITS = 24


def sliding_least(keys: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    span, least = 1, keys
    while 2 * span <= n:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    return np.minimum(least[: len(keys) - n + 1], least[n - span : n - span + len(keys) - n + 1]) if span < n else least


def anchors(block: TextBlock, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Hash and place of each anchor of the block's texts, and the first and last start of the windows that name it."""
    n = len(block.data) - gram + 1
    width = length - gram + 1
    if n < width:
        return tuple(np.zeros(0, t) for t in (U64, np.int64, np.int64, np.int64))
    hashes = block.grams(gram)
    # The place in the low bits makes the leftmost of equal grams the least; blocks above 2**_BITS bytes go in parts.
    found = []
    for a in range(0, n - width + 1, (1 << _BITS) - width):
        b = min(a + (1 << _BITS) - 1, n)
        keys = (hashes[a:b] & ~U64((1 << _BITS) - 1)) | np.arange(b - a, dtype=U64)
        if b - a >= width:
            found.append((sliding_least(keys, width) & U64((1 << _BITS) - 1)).astype(np.int64) + a)
            found[-1] = found[-1][: (1 << _BITS) - width]
    anchor = np.concatenate(found)
    last_start = np.repeat(block.ends, block.ends - block.starts + 1)[: len(anchor)] - length
    inside = np.flatnonzero(np.arange(len(anchor)) <= last_start)
    anchor, start = anchor[inside], inside
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)][: len(anchor)])
    last = np.r_[new[1:], len(anchor)] - 1
    return hashes[anchor[new]], anchor[new], start[new], start[last[: len(new)]]


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair of places, low < high."""
    if not len(low):
        return values[:0]
    return np.minimum.reduceat(np.r_[values, values[:1]], np.stack([low, high], axis=1).ravel())[::2]


def repeated_windows(
    segments: np.ndarray, ends: np.ndarray, places: np.ndarray, first: np.ndarray, last: np.ndarray, groups: np.ndarray, order: np.ndarray, length: int
) -> np.ndarray:
    """Marks (segment, column) of windows that an earlier segment of the group holds in the same column.

    segments: the bytes that follow each other; a segment's columns count from its anchor. ends: past its last byte there;
    places: the anchor's place in the bytes; first and last: columns of its first window and of its last one;
    groups: the segment's anchor group; order: the rank of its start in (doc, place).
    """
    n, low, high = len(ends), int(first.min(initial=0)), int((ends - places).max(initial=0))
    marked = np.zeros((n, max(int(last.max(initial=0)) - low + 1, 0)), bool)
    rows = np.lexsort((order, groups))  # the suffixes in order: at first empty ones, by group
    prefix = np.zeros(n, np.int16)  # common prefix with the suffix before
    for column in range(high - 1, low - 1, -1):
        at = places[rows] + column
        live = (at < ends[rows]) & (column >= first[rows])
        symbol = np.where(live, segments[np.minimum(np.maximum(at, 0), len(segments) - 1)].astype(np.int64) + 1, 0)
        key = groups[rows] * 257 + symbol
        by = np.argsort(key, kind="stable")
        same = np.zeros(n, bool)
        same[1:] = (key[by][1:] == key[by][:-1]) & (symbol[by][1:] > 0)
        k = np.flatnonzero(same)
        new = np.zeros(n, np.int16)
        new[k] = np.minimum(_least_between(prefix, by[k - 1] + 1, by[k] + 1), length - 1) + 1
        rows, prefix = rows[by], new
        # Suffixes with the same window lie together; the earliest of each run is the first occurrence.
        start = prefix < length
        run = np.cumsum(start) - 1
        if len(run) and run[-1] + 1 < n:
            least = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
            windows = (column >= first[rows]) & (column <= last[rows])
            np.minimum.at(least, run[windows], order[rows][windows])
            later = windows & (order[rows] > least[run])
            marked[rows[later], column - low] = True
    return marked


def _runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans that windows at the sorted starts cover."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + length])
    return starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]] + length


#: The first start of the windows that name an anchor lies place - reach // 128 back, and the last reach % 128 after it.
ANCHOR = "anchor long, content long, check int, row long, place int, reach int, sure boolean"


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """A row for each anchor; content and check are hashes of its segment and of where the anchor stands in it, of 95 bits together.

    Of equal segments in the texts at hand only the first has to meet the other texts'. The others are covered whole for
    sure, and get a number of their own for an anchor: however often a line comes, its rows are dealt out evenly.
    """
    key = new_key()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in text_blocks(batch.column(1)):
                block = TextBlock(texts, key=key)
                h, place, low, high = anchors(block)
                doc = np.searchsorted(block.starts, place, "right") - 1
                reach = (place - low) * 128 + high - low
                content, check = block.both_hashes(low, high + LENGTH)
                content = mixed(content ^ mixed(reach.astype(U64)))
                row = np.asarray(batch.column(0)[first:last])[doc].astype(np.int64)
                place = (place - block.starts[doc]).astype(np.int32)
                order = np.lexsort((place, row, check, content, h))
                again = np.zeros(len(h), bool)
                again[order[1:]] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (h, content, check)])
                h = np.where(again, mixed(content ^ mixed(row.astype(U64)) ^ place.astype(U64)), h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(content.view(np.int64)), *map(pa.array, (check.astype(np.int32), row, place, reach.astype(np.int32), again))],
                    ["anchor", "content", "check", "row", "place", "reach", "sure"],
                )

    return docs.mapInArrow(made, ANCHOR)


SEGMENT = "anchor long, row long, place int, low int, high int, contents long, bytes binary"
_NAMES = [x.split()[0] for x in SEGMENT.split(", ")]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of a document's found anchors, with the bytes of its segment."""
    for batch in batches:
        for i in range(batch.num_rows):
            text, found = batch["utf8"][i].as_py(), batch["found"][i].values
            anchor, place, reach, contents = (found.field(k) for k in range(4))
            low = np.asarray(place) - np.asarray(reach) // 128
            high = low + np.asarray(reach) % 128
            row = pa.array(np.full(len(found), batch["row"][i].as_py(), np.int64))
            cut = pa.array([text[a : b + LENGTH] for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([anchor, row, place, pa.array(low), pa.array(high), contents, cut], _NAMES)


def _spans(table: pa.Table) -> pa.RecordBatch:
    """The covered spans of whole anchor groups, as (row, start, end)."""
    group = np.unique(np.asarray(table["anchor"]), return_inverse=True)[1]
    row, place, low, high = (np.asarray(table[c]).astype(np.int64) for c in ("row", "place", "low", "high"))
    held = table["bytes"].combine_chunks()
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    data = np.frombuffer(held.buffers()[2], np.uint8)
    order = np.empty(len(row), np.int64)
    order[np.lexsort((place, row))] = np.arange(len(row))
    marked = repeated_windows(data, offsets[1:], offsets[:-1] + place - low, low - place, high - place, group, order, LENGTH)
    segment, column = np.nonzero(marked)
    start = column + int((low - place).min(initial=0)) + place[segment]
    new = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (start[1:] > start[:-1] + LENGTH)][: len(start)])
    last = np.r_[new[1:], len(start)] - 1
    columns = [row[segment[new]], start[new], start[last[: len(new)]] + LENGTH]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["row", "start", "end"])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes rows in the order of their anchors and hands on whole groups, some thousand segments at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        batch = batch.filter(pc.less_equal(batch["contents"], SEGMENTS))
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH:
            table = pa.Table.from_batches(held)
            anchor = np.asarray(table["anchor"])
            cut = int(np.searchsorted(anchor == anchor[-1], True))  # the last group may go on
            if cut:
                yield _spans(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                n = table.num_rows - cut
    if n:
        yield _spans(pa.Table.from_batches(held))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the segments that _sorted_groups() leaves out."""
    for batch in batches:
        batch = batch.filter(pc.greater(batch["contents"], SEGMENTS))
        for row, low, high, text in zip(*(batch[c].to_pylist() for c in ("row", "low", "high", "bytes")), strict=True):
            starts = np.arange(low, high + 1)
            windows = pa.array([text[k : k + LENGTH] for k in range(len(starts))], pa.binary())
            yield pa.RecordBatch.from_arrays([windows, pa.array(np.full(len(starts), row)), pa.array(starts)], ["window", "row", "start"])


def _joined(text: bytes, copy: bool, spans: pa.ListScalar) -> list[tuple[int, int]]:
    """The maximal runs of covered bytes of a text."""
    if copy:
        return [(0, len(text))] if len(text) >= LENGTH else []
    runs: list[tuple[int, int]] = []
    if spans.is_valid:
        for a, b in sorted(zip(spans.values.field(0).to_pylist(), spans.values.field(1).to_pylist(), strict=True)):
            if runs and a <= runs[-1][1]:
                runs[-1] = runs[-1][0], max(b, runs[-1][1])
            else:
                runs.append((a, b))
    return runs


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, text string"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN), pa.string()]


def _kept(texts: bool):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, copy, spans in zip(batch["utf8"], batch["copy"], batch["spans"], strict=True):
                text = text.as_py()
                runs = _joined(text, copy.as_py(), spans)
                ends = [0, *(x for s in runs for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if runs else text
                shown = [{"start": a, "end": b} for a, b in runs]
                rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), shown, kept.decode("utf-8", "ignore") if texts else None))
            columns = zip(*rows) if rows else [[]] * len(_TYPES)
            made = [pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)]
            carried = [batch.column(c) for c in range(batch.num_columns - 3)]
            names = [*batch.schema.names[1:-3], *(x.split()[0] for x in RESULT.split(", ")[1:])]
            yield pa.RecordBatch.from_arrays([*carried, *made], ["doc_id", *names])

    return made


def dedup_substrings(docs: DataFrame, carry: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and text (what is kept) of each row of docs (doc_id, text).

    The digest is over the kept bytes as they are; the text leaves out what is left of a character that a span cuts.
    carry names columns of docs that go along, as one struct ``carried``; without texts, text is null.

    A byte goes when some string of LENGTH bytes over it also starts earlier: in a document of a smaller doc_id, or before
    in the same one, overlapping or not. Strings are judged on the texts as they come. Null texts are empty; texts
    under LENGTH bytes stay whole; rows that repeat a doc_id follow one another by the SHA-256 of their texts, and a null
    doc_id comes before all. An empty table gives an empty table; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    carried = F.struct(*carry).alias("carried") if carry else F.lit(None).cast("struct<none:int>").alias("carried")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), carried, utf8().alias("utf8"))
    # A row's number: its doc_id where that is the row's own.
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if ids.isEmpty():
        rows = rows.withColumn("row", F.col("doc_id"))
    else:  # numbers in the order of the ids, over ranges of ids and digests, so that no task sees one id's rows alone
        ranged = rows.withColumn("digest", F.sha2("utf8", 256)).repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
        rows = cut_lineage(ranged.drop("digest").withColumn("row", F.monotonically_increasing_id()), "numbered")
    digest = rows.select("row", F.unhex(F.sha2("utf8", 256)).alias("digest"))
    firsts = cut_lineage(digest.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    copies = digest.join(firsts, "digest").where("row <> first").select("row", F.lit(True).alias("copy"))
    whole = rows.join(copies, "row", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    found = _anchor_rows(whole.where("not copy").select("row", "utf8"))
    anchor, of_content = Window.partitionBy("anchor"), Window.partitionBy("anchor").orderBy("content", "check", "row", "place")
    segment = F.struct("content", "check")
    before = F.coalesce(F.lag(segment).over(of_content) == segment, F.lit(False))
    found = found.withColumn("later", F.col("sure") | before).drop("sure", "check")
    found = found.withColumn("contents", F.count_if(~F.col("later")).over(anchor))
    found = found.where("later or contents > 1")
    # Of an anchor's equal segments the first stands for all, and the others are covered whole.
    low = F.col("place") - F.expr("reach div 128")
    whole_spans = F.collect_list(F.when(F.col("later"), F.struct(low.cast("long").alias("start"), (low + F.col("reach") % 128 + LENGTH).cast("long").alias("end"))))
    firsts = F.collect_list(F.when(~F.col("later"), F.struct("anchor", "place", "reach", "contents")))
    per_row = cut_lineage(found.groupBy("row").agg(whole_spans.alias("covered"), firsts.alias("found")), "anchors")
    # All columns of whole go along, so that the texts are shuffled once for this join and the last one.
    segments = whole.join(per_row.where(F.size("found") > 0).select("row", "found"), "row").mapInArrow(_cut, SEGMENT)
    dealt = segments.repartition("anchor")
    ordered = dealt.sortWithinPartitions("anchor", "row", "place").mapInArrow(_sorted_groups, "row long, start long, end long")
    windows = dealt.mapInArrow(_exploded, "window binary, row long, start long")
    first = windows.groupBy("window").agg(F.min(F.struct("row", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(first.select("window", "first"), "window").where("struct(row, start) > first")
    spans = ordered.unionByName(later.select("row", "start", (F.col("start") + LENGTH).alias("end")))
    spans = spans.unionByName(per_row.select("row", F.explode("covered").alias("s")).select("row", "s.start", "s.end"))
    per_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    done = whole.join(per_row, "row", "left").select("doc_id", "carried", "utf8", "copy", "spans")
    kind = done.schema["carried"].dataType.simpleString()
    return done.mapInArrow(_kept(texts), RESULT.replace("doc_id long", f"doc_id long, carried {kind}", 1))
