"""Features kept beside the files they are of: JSON rows, used again while they are younger than the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of the engine's own files; they have no features.
OWN_TYPES = ("CACHE", "LOCK")


def write(rows: DataFrame, path: str, version: str) -> None:
    """Write rows(path, ...) as JSON lines with the version of what computed them."""
    rows.withColumn("version", F.lit(version)).write.mode("append").json(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest cached row of each path, with ``cached_at``: when its JSON was written."""
    rows = spark.read.schema(f"path string, version string, {schema}").json(path).withColumn("cached_at", F.col("_metadata.file_modification_time"))
    return rows.filter(F.col("path").isNotNull()).groupBy("path").agg(F.max_by(F.struct(*rows.columns), "cached_at").alias("r")).select("r.*")


def reuse(files: DataFrame, cached: DataFrame | None, version: str, compute, second_hash, image: Column, of_path: list[str]) -> DataFrame:
    """files(path, modified, type, ...) with their features and ``origin``.

    * own types: ``own``, without features;
    * a cached row of this version, written when the file was last changed or later: ``cache``; what
      depends on the path (``of_path``, and the type) comes from the file as it lies now, not from the
      cache; an image without d_hash gets this one alone: ``filled``;
    * all else is computed anew: ``computed``. cached is None where the cache is switched off.

    compute(files) and second_hash(files) give features and (path, d_hash); each sees only the
    files that need it. ``origin`` other than ``cache`` and ``own`` is what has to be written to the cache.
    """
    own = files.filter(F.col("type").isin(*OWN_TYPES))
    rest = files.filter(~F.coalesce(F.col("type").isin(*OWN_TYPES), F.lit(False)))
    new = compute(files.limit(0))
    features = [c for c in new.columns if c != "path"]
    empty = own.select("*", *[F.lit(None).cast(dict(new.dtypes)[c]).alias(c) for c in features], F.lit("own").alias("origin"))
    if cached is None:
        return empty.unionByName(rest.join(compute(rest), "path").withColumn("origin", F.lit("computed")))
    known = cached.filter(F.col("version") == version).drop("version", "type", *of_path)
    valid = rest.join(known, "path").filter(F.col("modified") <= F.col("cached_at")).drop("cached_at")
    missing = image & F.col("d_hash").isNull()
    lacking = valid.filter(missing)
    filled = lacking.drop("d_hash").join(second_hash(lacking.select(*files.columns)), "path").withColumn("origin", F.lit("filled"))
    hits = valid.filter(~missing).withColumn("origin", F.lit("cache"))
    stale = rest.join(valid.select("path"), "path", "left_anti")
    computed = stale.join(compute(stale), "path").withColumn("origin", F.lit("computed"))
    columns = [*files.columns, *features, "origin"]
    out = empty.select(*columns)
    for part in (hits, filled, computed):
        out = out.unionByName(part.select(*columns))
    return out
