"""Labelled rows to learn from: bounded samples that depend on doc_ids alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by FOLDS: such rows' labels are never learnt. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def sample(labels: DataFrame, label: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``most`` labelled doc_ids of each class outside the held-out fold, and the classes' whole counts.

    The sample takes the rows with the smallest hashes of doc_id. Rows without id or label do not count; an id labelled
    more than once counts once, with its greatest label.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = rows.withColumn("draw", F.xxhash64("doc_id"))
    drawn = [rows.where(F.col("label") == c).orderBy("draw", "doc_id").limit(most) for c in (0, 1)]
    return drawn[0].unionByName(drawn[1]).select("doc_id", "label"), counts


