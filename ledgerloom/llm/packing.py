"""Best-fit packing by bound-certified repacking.

Documents become pieces of at most ``capacity`` tokens. Pieces are spread over partitions of bounded size, and each
partition packs its pieces by best-fit decreasing. Dual feasible functions give a lower bound on the sequences that a
partition needs. Where the bound is met the packing is certified; only its one sequence under half full may leave.
Partitions with a gap give up every sequence that is not full. What was given up is exchanged (spread anew over fewer
partitions) and packed again, until nothing moves or the last partition is done. A round that does not lower the
number of sequences is dropped. Only lengths are shuffled, never tokens or texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, utf8
from .tokens import coder, slices, vocabulary_path

CAPACITY = 4096
END_ID = 1
PIECES_A_PARTITION = 20_000
#: Words that a worker holds here, in some 50 bytes each: its memory stays within what a pipeline's other stages leave.
CACHE_WORDS = 1_500_000
ROUNDS = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document's ids and end id: doc_id, piece, start, length, ids_crc32. A null text is empty."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(vocabulary, False)
        encoder.most = CACHE_WORDS
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            made = []
            for part in slices([x.as_buffer() for x in texts]):
                found = encoder.encode([x.as_py() for x in texts[part.start : part.stop]])
                for doc_id, ids in zip(doc_ids[part], found, strict=True):
                    ids += end
                    for at in range(0, len(ids), 4 * capacity):
                        own = ids[at : at + 4 * capacity]
                        made.append((doc_id, at // (4 * capacity), at // 4, len(own) // 4, zlib.crc32(own)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), TYPES, strict=True)], NAMES)

    return docs.select(F.col("doc_id").cast("long"), utf8()).mapInArrow(cut, PIECES)


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The least number of bins of this capacity, by the best of two families of dual feasible functions.

    With e from 0 to half the capacity: lengths over capacity - e count as a bin, those under e as nothing, the others
    as themselves. With k from 1 to 20: a length x counts as floor((k + 1) x / capacity) / k bins, or as itself
    where (k + 1) x / capacity is whole.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    rows, tokens = np.cumsum(counts), np.cumsum(counts * sizes)
    e = np.arange(1, capacity // 2 + 1)
    bound = int((-(-(tokens[capacity - e] - tokens[e - 1]) // capacity) + rows[-1] - rows[capacity - e]).max(initial=0))
    bound = max(bound, -(-int(tokens[-1]) // capacity))
    for k in range(1, 21):
        whole = (k + 1) * sizes % capacity == 0
        value = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)  # in parts of 1 / (k capacity)
        bound = max(bound, -(-int((value * counts).sum()) // (k * capacity)))
    return bound


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length, and the room left in each bin."""
    bins = np.empty(len(lengths), np.int64)
    room: list[int] = []
    having: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    rooms = 0  # a bit for each room that some bin has
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fits = rooms >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            at = having[left].pop()
            if not having[left]:
                rooms &= ~(1 << left)
        else:
            left, at = capacity, len(room)
            room.append(0)
        left -= need
        room[at], bins[item] = left, at
        if left:
            having[left].append(at)
            rooms |= 1 << left
    return bins, np.array(room, np.int64)


def _packed(turn: int, capacity: int):
    """Packs the rows of one partition; moves tells which rows the next round gets."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        bins, room = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        gap = len(room) - bound
        moves = room > (0 if gap else capacity // 2)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.r_[0, np.flatnonzero(np.diff(bins[order])) + 1] if len(order) else order
        base = np.repeat((ends - lengths[order])[first], np.diff(np.r_[first, len(order)]))
        offset = np.empty(len(rows), np.int64)
        offset[order] = ends - lengths[order] - base
        number = (turn << 58) + (rows["part"].to_numpy(np.int64) << 24) + bins
        return rows.assign(sequence_id=number, offset=offset, moves=moves[bins], opens=offset == 0, gap=gap, bound=bound)

    return pack


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    pieces_a_partition: int = PIECES_A_PARTITION,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a piece of its end id alone; rows that repeat a doc_id are documents of their own and a
    null doc_id is passed on. An empty table gives an empty table. Other columns are ignored. The number of sequences
    is that of the last round, and never above that of packing each partition alone.
    """
    small_batches(docs.sparkSession)
    todo = cut_lineage(pieces(docs, vocabulary or vocabulary_path("word_bpe_49k.json"), capacity, end_id), "pieces")
    done, columns = None, [*todo.columns, "sequence_id", "offset"]
    fields = f"{PIECES}, part long, sequence_id long, offset long, moves boolean, opens boolean, gap long, bound long"
    was = None  # the last packing of the pieces that move
    for turn in range(rounds):
        n = todo.count()
        parts = max(1, -(-n // pieces_a_partition)) if turn == 0 else max(1, min(parts // 2, -(-n // pieces_a_partition)))
        key = F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(turn))
        dealt = todo.select(*todo.columns[:5], F.pmod(key, F.lit(parts)).alias("part"))
        packed = cut_lineage(dealt.groupBy("part").applyInPandas(_packed(turn, capacity), fields), f"packed-{turn}")
        opened = packed.where("opens").count()
        if was is not None and opened >= was.where("opens").count():
            break
        stay = packed.where("not moves")
        done, was = stay if done is None else done.unionByName(stay), packed.where("moves")
        todo = was
        if parts == 1 or was.isEmpty():
            break
    return done.unionByName(was).select(columns)
