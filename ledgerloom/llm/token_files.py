"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

The file format is a Parquet table of blocks, so that Spark's writers commit it on any store and a lost task leaves no
half file. A block holds consecutive documents in ascending doc_id order:

    part, block   place in the order: parts by range of doc_id, blocks inside a part
    doc_ids       array of the block's doc_ids
    lengths       array of their numbers of ids, end id included
    control       two bits for each id, four ids to a byte, lowest bits first: the id's data bytes less one
    data          each id's rank, little-endian, in one to four bytes

A rank is the id's place among all ids of the corpus by falling frequency (ties by id), so that common ids take one
byte; the table ``ranks`` beside the blocks maps ranks back to ids. Texts are tokenized once: ids go to an
intermediate table, are counted over all documents, and are then coded. Only the counts of the vocabulary reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, drop_tables, shared_folder, small_batches, utf8
from .tokens import coder, slices, vocabulary_path

END_ID = 2
IDS_A_BLOCK = 500_000

BLOCK = "part int, block int, doc_ids array<bigint>, lengths array<bigint>"
#: Data bytes of the four ids of each control byte.
WIDTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    width = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = width - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) < width[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks behind control and data bytes, by table lookup."""
    width = WIDTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(width, dtype=np.int64) - width
    held = np.frombuffer(data, np.uint8)
    ranks = held[at].astype(np.uint32)
    for k in range(1, 4):
        wide = wide[width[wide] > k] if k > 1 else np.flatnonzero(width > 1)
        ranks[wide] |= held[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _blocks(found: Iterable[tuple[int | None, bytes]], most: int) -> Iterator[tuple[list, list, bytes]]:
    doc_ids, lengths, held, n = [], [], [], 0
    for doc_id, ids in found:
        doc_ids.append(doc_id)
        lengths.append(len(ids) // 4)
        held.append(ids)
        n += len(ids) // 4
        if n >= most:
            yield doc_ids, lengths, b"".join(held)
            doc_ids, lengths, held, n = [], [], [], 0
    if doc_ids:
        yield doc_ids, lengths, b"".join(held)


def _tokenized(docs: DataFrame, vocabulary: str, keeps_space: bool, end_id: int, ids_a_block: int) -> DataFrame:
    """Blocks with their raw ids, as unsigned 16-bit or 32-bit integers by the vocabulary's size."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(vocabulary, keeps_space)
        narrow = np.dtype("<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")

        def found():
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for part in slices([x.as_buffer() for x in texts]):
                    ids = encoder.encode([x.as_py() for x in texts[part.start : part.stop]])
                    yield from ((d, x + end) for d, x in zip(doc_ids[part], ids, strict=True))

        part, total = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for k, (doc_ids, lengths, ids) in enumerate(_blocks(found(), ids_a_block)):
            ids = np.frombuffer(ids, "<u4")
            own = np.bincount(ids, minlength=len(total))
            own[: len(total)] += total
            total, ids = own, ids.astype(narrow).tobytes()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "block": k, "doc_ids": doc_ids, "lengths": lengths, "width": narrow.itemsize, "ids": ids}], RAW
            )
        seen = np.flatnonzero(total)
        # The task's counts, as a row beside its blocks: ids and how often each came.
        yield pa.RecordBatch.from_pylist([{"part": part, "block": COUNTS, "doc_ids": seen, "lengths": total[seen], "width": 0, "ids": b""}], RAW)

    small_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("utf8"))
    # Rows of one id, null ids above all, are dealt on by how their texts begin, which keeps the order by id and text.
    ordered = ordered.withColumn("begin", F.substring("utf8", 1, 64)).repartitionByRange("doc_id", "begin")
    ordered = ordered.drop("begin").sortWithinPartitions("doc_id", "utf8")
    return ordered.mapInArrow(encode, f"{BLOCK}, width int, ids binary")


COUNTS = -1

LISTS = [("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
RAW = pa.schema([*LISTS, ("width", pa.int32()), ("ids", pa.binary())])
CODED = pa.schema([*LISTS, ("control", pa.binary()), ("data", pa.binary())])


def _ids(width, ids) -> np.ndarray:
    return np.frombuffer(ids.as_buffer(), f"<u{width.as_py()}")


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    keeps_space: bool = True,
    end_id: int = END_ID,
    ids_a_block: int = IDS_A_BLOCK,
) -> None:
    """Writes the ids of every document of docs (doc_id, text) below path, as blocks/ and ranks/.

    A null or empty text has its end id only. A null doc_id comes first, rows that repeat a doc_id follow one another
    in the order of their texts. An empty table gives files without blocks. Other columns are ignored.
    """
    spark = docs.sparkSession
    raw = cut_lineage(_tokenized(docs, vocabulary or vocabulary_path("byte_bpe_50k.json"), keeps_space, end_id, ids_a_block), "raw-ids")
    counts = raw.where(F.col("block") == COUNTS).select(F.explode(F.arrays_zip("doc_ids", "lengths")).alias("c"))
    counts = counts.groupBy("c.doc_ids").agg(F.sum("c.lengths").alias("n"))
    ids, n = np.array(counts.collect(), np.int64).reshape(-1, 2).T  # a row for each id of the vocabulary at most
    ids = ids[np.lexsort((ids, -n))]
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                control, data = encode_ranks(rank_of[_ids(batch["width"][i], batch["ids"][i])])
                same = [batch.column(c)[i : i + 1] for c in range(4)]
                yield pa.RecordBatch.from_arrays([*same, pa.array([control]), pa.array([data])], schema=CODED)

    coded = raw.where(F.col("block") != COUNTS).mapInArrow(code, f"{BLOCK}, control binary, data binary")
    coded.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    ranks = spark.createDataFrame(list(enumerate(ids.tolist())), "rank int, id long")
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    drop_tables(spark, raw)


def _rank_table(spark: SparkSession, path: str) -> np.ndarray:
    ranks = np.array(spark.read.parquet(f"{path}/ranks").collect(), np.int64).reshape(-1, 2)
    return ranks[np.argsort(ranks[:, 0]), 1].astype(np.uint32)


def _decoded(spark: SparkSession, path: str, made, schema: str) -> DataFrame:
    """made(doc_ids, lengths, ids) gives the columns of schema after part and block, for each block."""
    ids_of = _rank_table(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, doc_ids, lengths, control, data in zip(*(batch.column(c) for c in range(6)), strict=True):
                lengths = np.array(lengths.as_py(), np.int64)
                ids = ids_of[decode_ranks(control.as_py(), data.as_py(), int(lengths.sum()))]
                columns = made(doc_ids.values, lengths, ids)
                n = len(lengths)
                place = [pa.array(np.full(n, x.as_py(), np.int32)) for x in (part, block)]
                yield pa.RecordBatch.from_arrays([*place, *columns], ["part", "block", *names])

    names = [x.split()[0] for x in schema.split(", ")]
    columns = ["part", "block", "doc_ids", "lengths", "control", "data"]
    blocks = spark.read.parquet(f"{path}/blocks").select(columns)
    return blocks.mapInArrow(decode, f"part int, block int, {schema}")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array of long) of each document, from the files alone."""

    def made(doc_ids, lengths, ids):
        ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
        return [doc_ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int64)))]

    return _decoded(spark, path, made, "doc_id long, ids array<long>").select("doc_id", "ids")


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""

    def made(doc_ids, lengths, ids):
        ends = np.cumsum(lengths)
        held = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        crcs = [zlib.crc32(held[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        return [doc_ids, pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())]

    rows = _decoded(spark, path, made, "doc_id long, inside long, n_tokens long, ids_crc32 long")
    lengths = spark.read.parquet(f"{path}/blocks").select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = lengths.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")
    starts = lengths.withColumn("before", before).join(parts, "part").select("part", "block", (F.col("ahead") + F.col("before")).alias("before"))
    return rows.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes docs' token files into the shared folder and returns their digest."""
    path = shared_folder(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary)
    return digest_token_files(docs.sparkSession, path)
