"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import time
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class for Java's and Python's regular expressions.
WHITE = r"[\x20\x09-\x0D]"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8(name: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.encode(text_or_empty(name), "UTF-8")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where the session names none, a temporary folder if Spark runs in one process.

    The folder goes when the application ends, since results may be read from it until then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _temporary_folder()
    path = f"{base.rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@cache
def _temporary_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"


def cut_lineage(df: DataFrame, name: str, release: bool = True) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read back; lost executors cost no recomputing.

    release: nothing needs the shuffle files behind the table any more, and Spark's cleaner drops them once the driver
    has collected its garbage.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    for _ in range(2 * release):  # the second time for what listeners still held the first time
        spark._jvm.System.gc()
        time.sleep(0.2)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of texts that go to a Python worker at once; texts are some kilobytes long, and some much longer.
TEXTS_A_BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    """Holds the session to small Arrow batches, which bound the memory of tasks that read whole texts in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS_A_BATCH:
        spark.conf.set(key, TEXTS_A_BATCH)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what cut_lineage() wrote for the frames, once nothing reads them any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
