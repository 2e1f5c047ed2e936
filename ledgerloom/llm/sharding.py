"""Sharding [native]: proportional stratified interleaving under the law "rows".

Rows are ranked in a seeded order inside their source; a row's fractional rank (2 rank - 1) / (2 rows of the source)
is its place in the whole order, and the order is cut into shards whose row counts differ by one at most. So every
shard, and every stretch of a shard, has the mixture of the whole table. Ranks are counted inside slices of the
(uniform) hash and of the fractional rank, plus the rows of the slices before, so no task sees a whole source or the
whole table, however large one source is. Only ids, sizes and digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, utf8

SHARDS = 8
SEED = "ledgerloom"
ROWS_A_SLICE = 20_000


def interleave(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_a_slice: int = ROWS_A_SLICE,
) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard for each row.

    The seeded order is the MD5 of seed, id and the text's CRC32; rows equal in all of these are interchangeable. A null
    source is a source of its own, a null id sorts as an empty one, a null text has no bytes (size 1, CRC32 0). Fewer
    rows than shards leave shards empty; an empty table gives an empty table. Extra columns are ignored.
    """
    slices = max(1, -(-docs.count() // rows_a_slice))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text_or_empty(text_col)) + 1).cast("long").alias("size"),
        F.crc32(utf8(text_col)).alias("text_crc32"),
    )
    rows = rows.withColumn(
        "draw", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")))
    ).withColumn("slice", (F.conv(F.substring("draw", 1, 7), 16, 10).cast("long") * slices / F.lit(16**7)).cast("int"))
    before = Window.partitionBy("stratum").orderBy("slice")
    counts = rows.groupBy("stratum", "slice").agg(F.count("*").alias("n"))
    counts = counts.select(
        "stratum",
        "slice",
        (F.sum("n").over(before) - F.col("n")).alias("ahead"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("of"),
    )
    within = Window.partitionBy("stratum", "slice").orderBy("draw", "doc_id", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within)).join(counts, ["stratum", "slice"])
    ranked = ranked.withColumn("place", (2 * (F.col("ahead") + F.col("rank")) - 1).cast("double") / (2 * F.col("of")))
    ranked = ranked.withColumn("stretch", (F.col("place") * slices).cast("int"))
    lengths = ranked.groupBy("stretch").agg(F.count("*").alias("n"))
    lengths = lengths.select(
        "stretch",
        (F.sum("n").over(Window.orderBy("stretch")) - F.col("n")).alias("first"),
        F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
    )
    order = Window.partitionBy("stretch").orderBy("place", "stratum", "draw", "doc_id", "size")
    placed = ranked.withColumn("nth", F.row_number().over(order)).join(lengths, "stretch")
    placed = placed.withColumn("at", F.col("first") + F.col("nth") - 1)
    placed = placed.withColumn("shard", F.expr(f"at * {shards} div all"))
    return placed.select(
        "doc_id",
        F.expr("if(stratum = '', null, substring(stratum, 2))").alias("source"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        # The first place of shard s is ceil(s * all / shards).
        (F.col("at") - F.expr(f"(shard * all + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED, files: int = 1) -> None:
    """Writes docs (unique ids) below path as shard=0, shard=1, ..., in slot order and in files of about equal rows.

    The shard and slot written are the placement's; columns of docs with these names are left out.
    """
    placed = interleave(docs, shards, seed).select(F.col("doc_id").alias("__id"), "shard", "slot")
    rows = docs.drop("shard", "slot").join(placed, docs["doc_id"].eqNullSafe(placed["__id"])).drop("__id")
    rows = rows.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").mode("overwrite").parquet(path)


ORACLE_SQL = f"""
WITH steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
         lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS steps
), sized AS (
  SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
             lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, steps
), drawn AS (
  SELECT *, coalesce('s' || source, '') AS stratum,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || text_crc32) AS draw
  FROM sized
), placed AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id NULLS FIRST, size) - 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY stratum)) AS place
  FROM drawn
), cut AS (
  SELECT *, row_number() OVER (ORDER BY place, stratum, draw, doc_id NULLS FIRST, size) - 1 AS pos, count(*) OVER () AS n
  FROM placed
)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, divide(pos * {SHARDS}, n)::INTEGER AS shard,
       pos - divide(divide(pos * {SHARDS}, n) * n + {SHARDS - 1}, {SHARDS}) AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
