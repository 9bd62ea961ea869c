"""Finding stored rows for incoming ones: exact, near (Hamming distance within a ratio band), by name and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.hashes import hamming64
from siftlake.sources.shared import cut

BAND = 0.2
SEARCH = 11
ACCEPTED = 200
P_EXACT, D_EXACT = 3, 8
#: Wider than the band, so that rounding never puts two rows within it more than one slot apart.
SLOT = 0.25
#: For searches by blocks: a bit over half the band, so that a row meets two slots on either side.
FINE_SLOT = 0.1001
#: The rows of a name are dealt into a part for every so many hits, and into so many parts at most.
HITS_A_PART, MOST_PARTS = 1000, 64


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("state") >= ACCEPTED)


def shuffled(rows: DataFrame) -> DataFrame:
    """Rows that are joined by a shuffle on both sides, however small the planner takes them to be: rows that were exploded or read from compressed files are larger, and a broadcast holds them in the driver."""
    return rows.hint("merge")


def _sides(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hash and ratio of rows that can match, and nothing else: the joins fan out on these."""
    a = incoming.select(F.col("doc_id").alias("in_id"), F.col("p_hash").alias("ip"), F.col("ratio").alias("ir"))
    b = accepted(stored).select(F.col("doc_id").alias("cat_id"), F.col("p_hash").alias("cp"), F.col("ratio").alias("cr"))
    return a.filter(F.col("ip").isNotNull() & ~F.isnan("ir")), b.filter(F.col("cp").isNotNull())


def _verified(joined: DataFrame, below: int = SEARCH) -> DataFrame:
    """in_id, cat_id, p_distance of pairs within the ratio band and the distance."""
    joined = joined.filter(F.col("cr").between(F.col("ir") - BAND, F.col("ir") + BAND)).withColumn("p_distance", hamming64(F.col("ip"), F.col("cp")))
    return joined.filter(F.col("p_distance") < below).select("in_id", "cat_id", "p_distance")


def near_dup_banded(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates by a ratio-bucket equi-join alone; where ratios cluster it compares most pairs."""
    a, b = _sides(incoming, stored)
    b = b.withColumn("slot", F.floor(F.col("cr") / SLOT)).withColumn("slot", F.explode(F.array(F.col("slot") - 1, "slot", F.col("slot") + 1)))
    return _verified(a.withColumn("slot", F.floor(F.col("ir") / SLOT)).join(shuffled(b), "slot"))


def blocks(h: Column, widths: list[int]) -> list[Column]:
    """The hash cut into blocks, lowest bits first."""
    out, at = [], 0
    for w in widths:
        out.append(F.shiftrightunsigned(h, at).bitwiseAND((1 << w) - 1))
        at += w
    return out


def _first_block(widths: list[int], differ: int) -> Column:
    """Number of the first block in which a joined pair differs in ``differ`` bits at most: the one where it counts."""
    apart = blocks(F.col("ip").bitwiseXOR(F.col("cp")), widths)
    return F.coalesce(*[F.when(F.bit_count(x) <= differ, i) for i, x in enumerate(apart)])


def _listed(value: Column, block: int, slot: Column | None) -> Column:
    """One number for a block, its value and the ratio's slot."""
    key = F.lit(block << 32).cast("long").bitwiseOR(value)
    return key if slot is None else F.shiftleft(slot, 36).bitwiseXOR(key)


def _block_of(listed: Column) -> Column:
    """The block in such a number."""
    return F.shiftright(listed, 32).bitwiseAND(15)


def near_dup_multi_index(incoming: DataFrame, stored: DataFrame, widths: tuple[int, ...] = (11, 11, 11, 11, 10, 10), slots: bool = True) -> DataFrame:
    """in_id, cat_id, p_distance by multi-index hashing: of six blocks of two hashes at distance 10 or less, one differs in one bit at most.

    Stored rows are listed once a block, with ``slots`` under their ratio's slot and two neighbours
    on either side too; incoming rows probe each block's value and its one-bit neighbours. A pair that
    meets in several blocks counts in the first, so nothing has to be made distinct. Comparisons grow
    with the product of both sides, so what is cheapest and leaves least is looked at first.
    """
    a, b = _sides(incoming, stored)
    # a column of its own, so that not every key works it out anew
    a, b = a.withColumn("slot", F.floor(F.col("ir") / FINE_SLOT)), b.withColumn("slot", F.floor(F.col("cr") / FINE_SLOT))
    slot, near = (F.col("slot"), [F.col("slot") + d for d in range(-2, 3)]) if slots else (None, [None])
    listed = F.array(*[_listed(v, i, s) for i, v in enumerate(blocks(F.col("cp"), widths)) for s in near])
    # first a row a block, then a row a bit: one expression for all keys of a row is too long to be compiled
    own = a.select("in_id", "ip", "ir", F.inline(F.array(*[F.struct(_listed(v, i, slot).alias("whole"), F.lit(w).alias("w")) for i, (v, w) in enumerate(zip(blocks(F.col("ip"), widths), widths))])))
    own = own.select("in_id", "ip", "ir", "whole", F.explode(F.sequence(F.lit(-1), F.col("w") - 1)).alias("bit"))
    flip = F.when(F.col("bit") < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))
    joined = shuffled(own.select("in_id", "ip", "ir", F.col("whole").bitwiseXOR(flip).alias("x"))).join(b.select("cat_id", "cp", "cr", F.explode(listed).alias("x")), "x")
    apart = hamming64(F.col("ip"), F.col("cp")) < SEARCH
    return _verified(joined.filter(apart).filter(_block_of(F.col("x")) == _first_block(widths, 1)))


def near_dup_sure(incoming: DataFrame, stored: DataFrame, widths: tuple[int, ...] = (22, 21, 21)) -> DataFrame:
    """Pairs at distance 2 or less: of three blocks one is equal."""
    a, b = _sides(incoming, stored)
    cut = lambda h: F.inline(F.array(*[F.struct(F.lit(i).alias("block"), v.alias("x")) for i, v in enumerate(blocks(F.col(h), widths))]))
    joined = shuffled(a.select("*", cut("ip"))).join(b.select("*", cut("cp")), ["block", "x"])
    return _verified(joined.filter(F.col("block") == _first_block(widths, 0)), P_EXACT)


def second_distance(pairs: DataFrame, hashes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """pairs(in_id, cat_id, ...) with d_distance from hashes(doc_id, d_hash), or from those of each side; null where either side has none."""
    side = lambda rows, k: rows.select(F.col("doc_id").alias(f"{k}_id"), F.col("d_hash").alias(f"{k}_d"))
    both = pairs.join(shuffled(side(hashes, "in")), "in_id", "left").join(shuffled(side(hashes if stored is None else stored, "cat")), "cat_id", "left")
    return both.withColumn("d_distance", hamming64(F.col("in_d"), F.col("cat_d"))).drop("in_d", "cat_d")


def sure(pairs: DataFrame) -> DataFrame:
    return pairs.filter((F.col("p_distance") < P_EXACT) & (F.col("d_distance") < D_EXACT))


def ranked(pairs: DataFrame) -> DataFrame:
    """Candidates of each incoming row numbered from the nearest."""
    order = Window.partitionBy("in_id").orderBy("p_distance", "cat_id")
    return pairs.withColumn("rank", F.row_number().over(order))


def exact_lookup(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """in_id, cat_id of the stored row with the same hash; rows with an empty hash aren't looked up, so no null key is shuffled."""
    keyed = incoming.filter(F.coalesce(F.col("hash"), F.lit("")) != "").select(F.col("doc_id").alias("in_id"), "hash")
    return keyed.join(stored.select("hash", F.col("doc_id").alias("cat_id"), "state"), "hash")


def name_lookup(incoming: DataFrame, stored: DataFrame, white: Column | None = None) -> DataFrame:
    """in_id, hits: the stored rows of the same name, in order and set apart by commas, for names off the white list.

    Hits are gathered and written out once a name, not once a row. Each row of a name gets all its hits, so what
    a name makes grows with the product of both; the rows of a name with many hits are dealt to several tasks.
    """
    asked, kept = (incoming, stored) if white is None else (incoming.filter(~white), stored.filter(~white))
    names = kept.filter(F.col("name").isNotNull()).groupBy("name").agg(F.array_sort(F.collect_list("doc_id")).alias("hits"))
    parts = F.least(F.ceil(F.size("hits") / HITS_A_PART), F.lit(MOST_PARTS)).cast("int")
    names = cut(names.select("name", F.concat_ws(",", F.transform("hits", lambda x: x.cast("string"))).alias("hits"), parts.alias("parts")), "names")
    rows = asked.select(F.col("doc_id").alias("in_id"), "name").join(shuffled(names.select("name", "parts")), "name")
    rows = rows.select("in_id", "name", F.pmod(F.xxhash64("in_id"), F.col("parts")).cast("int").alias("part"))
    copies = names.select("name", "hits", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return rows.join(shuffled(copies), ["name", "part"]).select("in_id", "hits")


def name_counts(incoming: DataFrame, stored: DataFrame, white: Column | None = None) -> DataFrame:
    """in_id, named (the first stored row of the same name), n_named (how many there are)."""
    asked = incoming if white is None else incoming.filter(~white)
    names = stored.groupBy("name").agg(F.min("doc_id").alias("named"), F.count("*").alias("n_named"))
    return asked.select(F.col("doc_id").alias("in_id"), "name").join(names, "name").select("in_id", "named", "n_named")


def exists(rows: DataFrame, listing: DataFrame, path: str = "to_path") -> DataFrame:
    """rows with ``present``: whether the path is in the listing."""
    return rows.join(shuffled(listing.select(F.col("to_path").alias(path), F.lit(True).alias("present"))), path, "left").withColumn("present", F.coalesce("present", F.lit(False)))


