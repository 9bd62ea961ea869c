"""Sharding by sampled splitters; the law is ``bytes``: shard sizes near equal.

Records are ordered by (group key, member key), both 64-bit hashes: the group key is the
text's, so equal texts lie together. A size-weighted sample of keys gives quantile
splitters; records are range-partitioned by them, ranges that turn out overfull are
sampled and split again, and prefix sums over the range totals place each record.

A group of equal texts keeps to one shard. Groups of over 1/64 of a shard, by bytes or records, are placed whole,
largest first, in the emptiest shard; the ranges of the other groups fill what room is left
and are cut at group edges. Only a group that no shard has room for is cut inside, by its
members' keys, over as many shards as it needs.

A range bounds what one task sorts, records without their texts. Its load is the mean of its
share of all bytes and its share of all records, so that neither long nor very many short
records gather in one; large groups, placed or cut, are split into ranges by their members' keys.

Defined results: null text has size 1, crc 0 and forms one group; null and repeated doc_ids
are records like others; equal records are interchangeable; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LOW = -(1 << 63)


def _range_ids(splitters: np.ndarray):
    """Range number of (g, m): how many splitters are at or below it. splitters: sorted rows (g, m)."""
    sg, sm = splitters[:, 0], splitters[:, 1]

    def assign(batches):
        for batch in batches:
            g = batch.column("g").to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(sg, g, "left"), np.searchsorted(sg, g, "right")
            at = hi.copy()
            same = np.flatnonzero(hi > lo)  # the key of a splitter: its member decides
            if len(same):
                m = batch.column("m").to_numpy(zero_copy_only=False)
                for key in np.unique(g[same]):
                    rows = same[g[same] == key]
                    first, last = np.searchsorted(sg, key, "left"), np.searchsorted(sg, key, "right")
                    at[rows] = first + np.searchsorted(sm[first:last], m[rows], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64))], [*batch.schema.names, "range"])

    return assign


def _sample(rows: DataFrame, wanted: float, salt: int) -> np.ndarray:
    """Keys drawn with a chance of load * wanted, decided by a hash of the record, so runs agree."""
    draw = (F.xxhash64("g", "m", F.lit(salt)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    got = rows.filter(draw < F.col("load") * wanted).select("g", F.when(F.col("big"), F.col("m")).otherwise(F.lit(LOW)).alias("m")).distinct()
    return np.array([tuple(r) for r in got.toLocalIterator()], np.int64).reshape(-1, 2)


def _quantiles(keys: np.ndarray, n: int) -> np.ndarray:
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    return keys[np.unique(np.linspace(0, len(keys), n + 1).astype(int)[1:-1].clip(0, max(0, len(keys) - 1)))] if len(keys) else keys


def _place(heavy: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, int], list[float], list[int]]:
    """Whole placement of heavy groups: group -> shard, room left in each shard, groups to be cut."""
    share, placed, cut = total / shards, {}, []
    loads = [(0, k) for k in range(shards)]
    for g, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        if loads[0][0] + size > share:
            cut.append(g)
            continue
        load, k = heapq.heappop(loads)
        placed[g] = k
        heapq.heappush(loads, (load + size, k))
    return placed, [share - load for load, _ in sorted(loads, key=lambda x: x[1])], cut


def shard_by_bytes(docs: DataFrame, shards: int = 16, range_rows: int = 250_000, most_ranges: int = 16_384, sample_per_range: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of docs(doc_id, text).

    There are as many ranges as hold ``range_rows`` records each, 64 at least and
    ``most_ranges`` at most. Goes to the driver: the splitter sample (about sample_per_range
    keys a range, and as many for overfull ones) and groups of over 1/64 of a shard by bytes or records
    (128 * shards at most).
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("g"),
        F.xxhash64("doc_id", F.col("text").isNull()).alias("m"),
    )
    rows = common.cut(rows, "shard-keys")
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    total, n = whole["bytes"] or 0, whole["n"]
    heavy = [(r["g"], r["bytes"]) for r in groups.filter((F.col("bytes") > total / shards / 64) | (F.col("n") > n / shards / 64)).collect()]
    placed, room, cut = _place(heavy, shards, total)
    known = spark.createDataFrame([(g, s, False) for g, s in placed.items()] + [(g, None, True) for g in cut], "g long, fixed int, big boolean")
    rows = rows.join(F.broadcast(known), "g", "left").withColumn("cut", F.coalesce("big", F.lit(False))).withColumn("big", F.col("big").isNotNull())
    rows = rows.withColumn("load", F.col("size") / F.lit(2.0 * max(1, total)) + F.lit(0.5 / max(1, n)))

    ranges = min(most_ranges, max(64, -(-n // range_rows)))
    splitters, target = _quantiles(_sample(rows, float(sample_per_range * ranges), 0), ranges), 1.0 / ranges
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", range long"
    for salt in range(1, 4):
        dealt = rows.mapInArrow(_range_ids(splitters), schema)
        full = dealt.groupBy("range").agg(F.sum("load").alias("loads"), F.max("load").alias("most"))
        over = full.filter((F.col("loads") > 2 * target) & (F.col("most") < F.col("loads") / 2)).select("range")
        more = _sample(dealt.join(over, "range", "left_semi"), sample_per_range / target / 4, salt)
        if not len(more):
            break
        splitters = np.unique(np.concatenate([splitters, more]), axis=0)
    dealt = rows.mapInArrow(_range_ids(splitters), schema)

    free = F.when(F.col("fixed").isNull(), F.col("size")).otherwise(0)
    totals = dealt.groupBy("range").agg(F.sum(free).alias("n"))
    before = totals.select("range", (F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    order = Window.partitionBy("range").orderBy("g", "m", "doc_id", "size", "text_crc32")
    at = F.col("base") + F.sum(free).over(order.rowsBetween(Window.unboundedPreceding, 0)) - free
    placed_at = dealt.join(before, "range").withColumn("at", at)
    placed_at = placed_at.withColumn("at", F.when(F.col("cut"), F.col("at")).otherwise(F.min("at").over(Window.partitionBy("range", "g"))))
    edges = np.cumsum(room)[:-1].tolist()
    shard = F.coalesce("fixed", sum((F.when(F.col("at") >= e, 1).otherwise(0) for e in edges), F.lit(0)))
    placed_at = common.cut(placed_at.select("doc_id", "size", "text_crc32", "g", "m", "range", shard.cast("int").alias("shard")), "shard-places")

    counts = placed_at.groupBy("shard", "range").agg(F.count("*").alias("n"))
    first = counts.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    slot = F.col("first") + F.row_number().over(Window.partitionBy("range", "shard").orderBy("g", "m", "doc_id", "size", "text_crc32")) - 1
    return placed_at.join(first, ["range", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
