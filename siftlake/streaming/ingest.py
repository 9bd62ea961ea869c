"""Incremental jobs over file sources: each run takes what has arrived since the last (availableNow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.sources.shared import cut, new_dir

BUCKETS = 16
#: A backlog of more batches is worked off by so many triggers, each of which takes several batches.
TRIGGERS = 64


def work_dir(spark: SparkSession) -> str:
    """A new folder that every node sees."""
    return new_dir(spark, "stream")


def run_batches(spark: SparkSession, source: DataFrame, folder: str, step, per_trigger: int | None = None) -> None:
    """Feed a folder's parquet files to step(batch, id); batches are replayed under the same id after a failure."""
    reader = spark.readStream.schema(source.schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    query = reader.parquet(f"{folder}/in").writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def run_arrivals(spark: SparkSession, arriving: DataFrame, key: str, parts: int, folder: str, step) -> None:
    """Rows that arrive in parts, by ranges of a key: each part's files are written, and then taken as one batch by a run that goes on where the last one ended."""
    at = arriving.approxQuantile(key, [i / parts for i in range(1, parts)], 0.01)
    for low, high in zip([None, *at], [*at, None]):
        part = arriving.filter((F.lit(True) if low is None else F.col(key) > low) & (F.lit(True) if high is None else F.col(key) <= high))
        part.write.mode("append").parquet(f"{folder}/in")
        run_batches(spark, arriving, folder, step)


def judged_stream(spark: SparkSession, arriving: DataFrame, key: str, prepare, judge, mutate, files: int = 3) -> DataFrame:
    """Verdicts of rows judged as their files arrive, each batch alone.

    prepare(batch) gives the batch's rows, which are written and are what the others get.
    judge(rows, earlier) gives the verdicts and, as (hash, place, stored), what they leave for
    later batches to find; mutate(rows, verdicts) the changes of the catalogue. Each batch
    writes all three under its id, so a replay overwrites its own part and sees that of earlier
    batches only.
    """
    folder = work_dir(spark)

    def step(batch: DataFrame, i: int) -> None:
        rows = cut(prepare(batch), "batch")
        earlier = spark.read.parquet(*[f"{folder}/stored/batch={k}" for k in range(i)]) if i else None
        verdicts, stored = judge(rows, earlier)
        verdicts = cut(verdicts, "verdicts")
        for name, table in (("out", verdicts), ("stored", stored(verdicts)), ("changes", mutate(rows, verdicts))):
            table.write.mode("overwrite").parquet(f"{folder}/{name}/batch={i}")

    run_arrivals(spark, arriving, key, files, folder, step)
    return spark.read.parquet(f"{folder}/out").drop("batch")


def applied_stream(spark: SparkSession, arriving: DataFrame, key: str, first: DataFrame, judge, files: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows judged as their files arrive and applied at once: the verdicts, and the catalogue that they leave.

    judge(batch, stored) gives verdicts and the next snapshot. Batch i reads version i of the
    catalogue and writes version i + 1, and its verdicts under its id. A version counts once its
    write is committed, which is what moves the pointer on; a batch that is replayed, whatever it had
    written, reads the same version and writes the same again.
    """
    folder = work_dir(spark)
    version = lambda i: f"{folder}/catalog/version={i}"
    first.write.parquet(version(0))

    def step(batch: DataFrame, i: int) -> None:
        verdicts, snapshot = judge(cut(batch, "batch"), spark.read.schema(first.schema).parquet(version(i)))
        cut(verdicts, "verdicts").write.mode("overwrite").parquet(f"{folder}/out/batch={i}")
        snapshot.write.mode("overwrite").parquet(version(i + 1))

    run_arrivals(spark, arriving, key, files, folder, step)
    return spark.read.parquet(f"{folder}/out").drop("batch"), spark.read.schema(first.schema).parquet(version(last_version(spark, f"{folder}/catalog")))


def last_version(spark: SparkSession, folder: str) -> int:
    """The newest committed version of a catalogue."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return max(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def first_seen(spark: SparkSession, rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose keys weren't seen within the delay before, by a streaming deduplication with a watermark."""
    folder = work_dir(spark)
    rows.write.parquet(f"{folder}/in")
    return first_seen_in(spark, folder, rows.schema, keys, time, delay)


def first_seen_in(spark: SparkSession, folder: str, schema, keys: list[str], time: str, delay: str, per_trigger: int | None = None) -> DataFrame:
    """The same of what has arrived under folder/in; further calls go on where the last one ended.

    A key is held until the watermark, the greatest time of former triggers less the delay, passes its
    time by the delay; then its state goes and the key counts as new. Rows older than the watermark are
    late and are left out.
    """
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    stream = reader.parquet(f"{folder}/in").withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def patched_table(spark: SparkSession, patches: DataFrame, key: str, order: str, fields: list[str], files: int = 3) -> DataFrame:
    """The table that patches leave: each batch folds to the latest value of a field a key and is merged into the buckets that it touches.

    A value carries its order, and the latest wins, so replaying a batch changes nothing.
    """
    folder = work_dir(spark)
    patches.coalesce(files).write.parquet(f"{folder}/in")
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")
    stored = [F.when(F.col(f).isNotNull(), F.struct(F.col(order).alias("o"), F.col(f).alias("v"))).alias(f) for f in fields]
    empty = patches.select(key, *stored, bucket).limit(0)
    empty.write.partitionBy("bucket").parquet(f"{folder}/table")

    def merge(batch: DataFrame, i: int) -> None:
        new = cut(batch.select(key, *stored, bucket), "patches")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        old = spark.read.schema(empty.schema).parquet(f"{folder}/table").filter(F.col("bucket").isin(touched))
        merged = cut(old.unionByName(new).groupBy("bucket", key).agg(*[F.max(f).alias(f) for f in fields]), "merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/table")

    run_batches(spark, patches, folder, merge, per_trigger=1)
    return spark.read.schema(empty.schema).parquet(f"{folder}/table").select(key, *[F.col(f"{f}.v").alias(f) for f in fields])


def drained(spark: SparkSession, backlog: DataFrame, batch: int, key: str, most: int | None = None) -> DataFrame:
    """A backlog worked off by a stream in batches of a given size, in the order of the key, until it or ``most`` batches are done.

    Numbers come from counts of key ranges and ranks within them, so no task sorts it all. A
    trigger takes one file: a batch, or a run of as many successive ones as ``TRIGGERS`` triggers
    ask for, since each costs the same whatever it holds. The run ends when none is left.
    """
    folder = work_dir(spark)
    ranged = cut(backlog.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "backlog")
    counts = cut(ranged.groupBy("part").count(), "counts")
    batches = -(-(counts.agg(F.sum("count")).first()[0] or 0) // batch)
    run = max(1, -(-(batches if most is None else min(batches, most)) // TRIGGERS))
    sizes = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1 + F.col("base")
    numbered = ranged.join(sizes, "part").withColumn("batch", F.floor(rank / batch).cast("long")).drop("part", "base")
    numbered = numbered if most is None else numbered.filter(F.col("batch") < most)
    schema = numbered.schema
    runs = numbered.withColumn("run", F.floor(F.col("batch") / run).cast("long"))
    runs.repartition("run").write.partitionBy("run").parquet(f"{folder}/in")
    numbered.limit(0).write.parquet(f"{folder}/out/trigger=-1")  # an empty backlog triggers nothing
    query = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").writeStream
    done = query.foreachBatch(lambda rows, i: rows.write.mode("overwrite").parquet(f"{folder}/out/trigger={i}"))
    done.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out").select(*schema.names)
