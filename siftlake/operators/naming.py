"""Free names: every row gets the path it wants or the first free numbered one, as if rows came one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.sources.shared import cut

from .matching import shuffled

#: What numbering makes of a path: an underscore and a number from 1, without leading zeros.
NUMBERED = r"^((?s:.*))_([1-9][0-9]{0,8})$"


def running_total(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with the total of ``value`` over the rows of the same key that come before.

    Rows are dealt by ranges of key and order; a key's total before a range is the sum of those of
    earlier ranges, so a hot key is spread over many tasks, and no window holds more than a range's part.
    """
    ranged = cut(rows.withColumn("_v", value.cast("long")).repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(key, "_part").agg(F.sum("_v").alias("_s"))
    before = sums.select(key, "_part", (F.sum("_s").over(Window.partitionBy(key).orderBy("_part")) - F.col("_s")).alias("_base"))
    inner = F.sum("_v").over(Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn(name, F.coalesce(inner, F.lit(0))).join(shuffled(before), [key, "_part"]).withColumn(name, F.col(name) + F.col("_base")).drop("_v", "_part", "_base")


def _parent(path: Column) -> tuple[Column, Column]:
    """The path that a numbered one was made of, and the number; nulls for others."""
    numbered = path.rlike(NUMBERED)
    return F.when(numbered, F.regexp_extract(path, NUMBERED, 1)), F.when(numbered, F.regexp_extract(path, NUMBERED, 2).cast("long"))


def _contest(contested: DataFrame, blocked: DataFrame, placed: DataFrame) -> DataFrame:
    """contested(p, k, q, first) with ``wins``: whether a row that wants p comes to slot k before any row that wants q."""
    marks = blocked.select("p", "k", F.lit(1).alias("b")).unionByName(contested.select("p", "k", F.lit(0).alias("b"))).groupBy("p", "k").agg(F.max("b").alias("b"))
    lower = running_total(marks, "p", "k", F.col("b"), "lower").select("p", "k", "lower")
    taker = placed.select(F.col("path").alias("p"), (F.col("place") + 1).alias("j"), F.col("order").alias("taker"))
    found = contested.drop("wins").join(lower, ["p", "k"]).withColumn("j", F.col("k") + 1 - F.col("lower")).join(taker, ["p", "j"], "left")
    return found.select("p", "k", "q", "first", F.coalesce(F.col("taker") < F.col("first"), F.lit(False)).alias("wins"))


def without_collisions(rows: DataFrame, taken: DataFrame, path: str, order: str) -> DataFrame:
    """rows with ``final_path``: their path, or with ``_1``, ``_2``, ... the first that is neither in taken(to_path) nor an earlier row's.

    order tells rows apart. Rows that want one path fill its slots (0 is the plain path) in their
    order, so row n gets the n-th slot that isn't blocked. A slot k of path p is also the plain path
    of rows that want ``p_k``: the earlier of the row that comes to it from p and the first that wants
    it plainly gets it, and it is blocked for the others. Who comes to it depends on which slots before
    are blocked, so contests are settled in rounds until none changes. A contest depends on earlier rows
    only; hence the rounds end, with what one row after another would get.
    """
    placed = cut(running_total(rows.select(F.col(path).alias("path"), F.col(order).alias("order")), "path", "order", F.lit(1), "place"), "placed")
    families = cut(placed.groupBy("path").agg(F.count("*").alias("n"), F.min("order").alias("first")), "families")
    parent, number = _parent(F.col("to_path"))
    held = taken.select("to_path").distinct()
    held = held.select(F.explode(F.array(F.struct(F.col("to_path").alias("p"), F.lit(0).cast("long").alias("k")), F.struct(parent.alias("p"), number.alias("k")))).alias("x")).select("x.*")
    held = cut(held.join(families.select(F.col("path").alias("p")), "p", "left_semi"), "held")
    parent, number = _parent(F.col("path"))
    contested = families.select(parent.alias("p"), number.alias("k"), F.col("path").alias("q"), "first").join(families.select(F.col("path").alias("p")), "p", "left_semi")
    contested = cut(contested.join(held, ["p", "k"], "left_anti").withColumn("wins", F.lit(False)), "contested")
    while True:
        lost = contested.select(F.when(F.col("wins"), F.col("q")).otherwise(F.col("p")).alias("p"), F.when(F.col("wins"), 0).otherwise(F.col("k")).cast("long").alias("k"))
        blocked = cut(held.unionByName(lost).distinct(), "blocked")
        if contested.isEmpty():
            break
        now = cut(_contest(contested, blocked, placed), "contested")
        same = now.join(contested.select("q", F.col("wins").alias("was")), "q").filter(F.col("wins") != F.col("was")).isEmpty()
        contested = now
        if same:
            break
    # as many slots as rows and blocked ones: the rows' own numbers, and one beyond for each blocked one
    beyond = running_total(blocked, "p", "k", F.lit(1), "i").join(families.select(F.col("path").alias("p"), "n"), "p").select("p", (F.col("n") + F.col("i")).alias("k"))
    slots = placed.select(F.col("path").alias("p"), F.col("place").alias("k")).unionByName(beyond).join(blocked, ["p", "k"], "left_anti")
    free = running_total(slots, "p", "k", F.lit(1), "place").select(F.col("p").alias("path"), "place", "k")
    final = F.when(F.col("k") == 0, F.col("path")).otherwise(F.concat("path", F.lit("_"), F.col("k").cast("string")))
    given = placed.join(free, ["path", "place"]).select(F.col("order").alias("_order"), final.alias("final_path"))
    return rows.join(given, rows[order] == given["_order"]).drop("_order")
