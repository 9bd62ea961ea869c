"""What the two vector searches share: usable rows, query and data blocks, top-k merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (doubles) of the rows whose vector is neither null nor empty and holds finite components only."""
    vec = F.transform(vec_col, lambda x: x.cast("double"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table.select(F.col(id_col).alias("id"), vec.alias("vec")).filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & F.col("id").isNotNull() & fine)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 0))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(ids) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def merge(found: DataFrame, k: int, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query's finds in all blocks."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(kind).alias("score"))
