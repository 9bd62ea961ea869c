"""What the operators of this folder share: intermediate tables, table reading, fixed text rules."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every node sees: spark.checkpoint.dir, or, where that is unset (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if not found:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="siftlake-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step", parts: tuple[str, ...] = ()) -> DataFrame:
    """Write to the shared folder and read again: later jobs start here, whatever executors are lost."""
    path = scratch(df.sparkSession, name)
    schema = df.schema
    with tidied(df.sparkSession):
        df.write.partitionBy(*parts).parquet(path)
    reader = df.sparkSession.read if parts else df.sparkSession.read.schema(schema)
    return _written(reader.parquet(path), path)


def _written(found: DataFrame, path: str) -> DataFrame:
    """Notes where a table lies, and has the driver drop what else led to it: broadcasts and shuffles of earlier actions stay until its garbage is collected."""
    found._scratch = path
    gc.collect()
    found.sparkSession.sparkContext._jvm.System.gc()
    return found


@contextlib.contextmanager
def tidied(spark: SparkSession):
    """Queries that end within leave no shuffle files behind: each table that is written needs the disk of its own shuffles only."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(conf).delete(path, True)


def cut_by(df: DataFrame | Iterator[DataFrame], key: str, name: str = "step") -> DataFrame:
    """As ``cut``, in buckets sorted by a key, so that joins on the key don't shuffle these rows again.

    Of several tables one is written after another. Rows that a grouping by the key has dealt already lie in the buckets of their task alone. Buckets
    come with a table only; its entry in the session's catalog goes at once, the files stay.
    """
    spark, label = SparkSession.active(), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    parts, path = shuffle_parts(spark), scratch(spark, name)
    for t in [df] if isinstance(df, DataFrame) else df:
        with tidied(spark):
            t.write.mode("append").bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(label)
    found = spark.table(label)
    found.schema  # resolved: the entry isn't needed any more
    spark.sql(f"DROP TABLE {label}")
    return _written(found, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; the fold a document belongs to comes from it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_key(column: str = "text") -> Column:
    """128-bit identity of a text (null: null)."""
    return F.unhex(F.md5(F.col(column).cast("binary")))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
