"""Snapshot merges: parquet has no MERGE, so each gives the next snapshot as a DataFrame; writing it is a separate call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """stored with new rows in place of those of the same key, of one column or several; of several new rows the last by ``order`` wins.

    max_by folds rows of a key map-side, so a key with many updates isn't gathered.
    """
    columns = stored.columns
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.select(*columns).withColumn("_new", F.lit(1)))
    last = both.groupBy(*([key] if isinstance(key, str) else key)).agg(F.max_by(F.struct(*columns), F.struct("_new", order)).alias("row"))
    return last.select(*[F.col(f"row.{c}").alias(c) for c in columns])


def insert_only(stored: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that can be appended, and the conflicts."""
    keys = stored.select(key)
    return new.join(keys, key, "left_anti"), new.join(keys, key, "left_semi")


def delete(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """stored without the keys of ``gone``; empty keys delete nothing."""
    return stored.join(gone.filter(F.coalesce(F.col(key), F.lit("")) != "").select(key), key, "left_anti")
