"""Exact deduplication [native]: group by a 128-bit content hash, keep the smallest id, compare bytes in the groups.

Two passes over the texts. The first aggregates by the MD5 of the normalised text: smallest id, rows, and the
smallest and largest normalised text, which are the same bytes exactly when every text of the group is. Copies fold
on the map side, so a group that holds a third of all rows sends one row from each task. The second pass carries
ids and digests only. Groups whose bytes differ (a hash collision) are grouped again by hash and bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, cut_lineage, text_or_empty


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; a null text is empty, so
    empty and null texts form one group and blank texts another. The smallest id of a group stays; null ids count in
    group_size and stay only where a group has no other. Rows that repeat id and text give one kept row. An empty
    table gives an empty table; other columns are ignored.
    """
    normal = docs.select(
        F.col(id_col).alias("doc_id"), F.regexp_replace(text_or_empty(text_col), f"{WHITE}+", " ").alias("normal")
    ).withColumn("hash", hashed(F.col("normal")))
    summed = [F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    groups = cut_lineage(
        normal.groupBy("hash")
        .agg(*summed, F.min("normal").alias("least"), F.max("normal").alias("most"))
        .select("hash", "keep_id", "group_size", (F.col("least") != F.col("most")).alias("collision")),
        "exact-groups",
    )
    same = Window.partitionBy("hash", "doc_id").orderBy("text_sha256")
    rows = normal.select("doc_id", "hash", F.sha2("normal", 256).alias("text_sha256"))
    rows = rows.withColumn("copy", F.row_number().over(same))
    joined = rows.join(groups.where("not collision"), "hash")
    if not groups.where("collision").isEmpty():
        mixed = normal.join(groups.where("collision").select("hash"), "hash", "left_semi")
        apart = mixed.groupBy("hash", "normal").agg(*summed, F.lit(True).alias("collision"))
        same = Window.partitionBy("hash", "doc_id", "normal").orderBy("doc_id")
        mixed = mixed.withColumn("copy", F.row_number().over(same)).join(apart, ["hash", "normal"])
        joined = joined.unionByName(mixed.withColumn("text_sha256", F.sha2("normal", 256)).select(joined.columns))
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat id and text one stays."""
    groups = exact_groups(docs, id_col, text_col)
    kept = groups.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    digest = F.sha2(F.regexp_replace(text_or_empty(text_col), f"{WHITE}+", " "), 256)
    rows = docs.withColumn("__own", digest)
    rows = rows.join(kept, rows[id_col].eqNullSafe(kept["__id"]) & (rows["__own"] == kept["__digest"]), "left_semi")
    again = docs.groupBy(id_col).agg(F.count("*").alias("__n")).where("__n > 1")
    return (rows if again.isEmpty() else rows.dropDuplicates([id_col, "__own"])).drop("__own")


ORACLE_SQL = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM documents
), grouped AS (
  SELECT normal, min(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY normal
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.normal) AS text_sha256
FROM normal n JOIN grouped g USING (normal)
"""
