"""A stored index of similarity hashes, for searches of a catalogue that is read often and changed little.

The index lists every distinct pair of hash and ratio once for each block of the hash and slot of the
ratio, in files bucketed and sorted by that key, so a search shuffles what it looks for and not the
index. Blocks are as wide as the number of rows asks for: of m blocks one differs in 10 / m bits at
most, so wider blocks hold fewer rows a value, and more values have to be probed. ``scheme`` takes what
compares least. New rows are appended; a row that is no longer accepted stays listed and falls out when
candidates meet the catalogue as it is now. Copies share an entry, so no value is hot because of them.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.hashes import hamming64
from siftlake.sources.shared import cut

from . import matching as M

#: Block widths of each scheme, by the number of blocks; 64 bits in all.
WIDTHS = {6: (11, 11, 11, 11, 10, 10), 5: (13, 13, 13, 13, 12), 4: (16, 16, 16, 16), 3: (22, 21, 21)}
BUCKETS = 64
COLUMNS = "x LONG, block INT, cp LONG, cr DOUBLE"


def radius(blocks: int) -> int:
    """Bits in which the best of so many blocks differs at most."""
    return (M.SEARCH - 1) // blocks


def probes(width: int, bits: int) -> list[int]:
    """All patterns of a block with so many bits set at most."""
    return [sum(1 << i for i in c) for r in range(bits + 1) for c in itertools.combinations(range(width), r)]


def scheme(rows: int) -> int:
    """The number of blocks for so many listed rows a slot: the least of values probed and rows met, as if values were even."""
    cost = lambda m: sum(len(probes(w, radius(m))) * (1 + rows / 2**w) for w in WIDTHS[m])
    return min(WIDTHS, key=cost)


def _keys(value: DataFrame, widths: tuple[int, ...], slots: list) -> list:
    return [F.struct(F.lit(i).alias("block"), M._listed(v, i, s).alias("x")) for i, v in enumerate(M.blocks(value, widths)) for s in slots]


def listing(stored: DataFrame, blocks: int) -> DataFrame:
    """x, block, cp, cr of accepted rows(p_hash, ratio, state), one entry a hash and ratio."""
    rows = M.accepted(stored).filter(F.col("p_hash").isNotNull() & F.col("ratio").isNotNull() & ~F.isnan("ratio"))
    rows = rows.select(F.col("p_hash").alias("cp"), F.col("ratio").cast("double").alias("cr")).distinct()
    slots = [F.floor(F.col("cr") / M.SLOT) + d for d in (-1, 0, 1)]
    return rows.select("cp", "cr", F.inline(F.array(*_keys(F.col("cp"), WIDTHS[blocks], slots)))).select("x", "block", "cp", "cr")


def _table(spark: SparkSession, path: str) -> str:
    """A name for the index's files in this session's catalog; the files are the index, the name comes and goes."""
    name = f"hash_index_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({COLUMNS}) USING parquet CLUSTERED BY (x) SORTED BY (x) INTO {BUCKETS} BUCKETS LOCATION '{path}/entries'")
    return name


def create(stored: DataFrame, path: str, blocks: int | None = None) -> int:
    """Write the index of stored rows under a new path; gives the number of blocks, taken from the row count where not given."""
    spark = stored.sparkSession
    if blocks is None:
        slots = M.accepted(stored).groupBy(F.floor(F.col("ratio") / M.SLOT).alias("slot")).count()
        # a row meets those of three slots; the fullest one is what has to be searched
        blocks = scheme(3 * (slots.agg(F.max("count")).first()[0] or 0))
    spark.createDataFrame([(blocks,)], "blocks int").coalesce(1).write.json(f"{path}/scheme")
    add(stored, path, blocks)
    return blocks


def add(rows: DataFrame, path: str, blocks: int | None = None) -> None:
    """Append the entries of rows that have become accepted."""
    spark = rows.sparkSession
    blocks = blocks or scheme_of(spark, path)
    name = _table(spark, path)
    listing(rows, blocks).repartition(BUCKETS, "x").sortWithinPartitions("x").write.insertInto(name)
    spark.sql(f"DROP TABLE {name}")


def scheme_of(spark: SparkSession, path: str) -> int:
    return spark.read.schema("blocks int").json(f"{path}/scheme").first()[0]


def met(incoming: DataFrame, path: str) -> DataFrame:
    """ip, ir, cp, cr, block of the entries that incoming hashes meet, before any check: what a search compares."""
    spark = incoming.sparkSession
    blocks = scheme_of(spark, path)
    widths, bits = WIDTHS[blocks], radius(blocks)
    asked = incoming.select(F.col("p_hash").alias("ip"), F.col("ratio").cast("double").alias("ir")).filter(F.col("ip").isNotNull() & F.col("ir").isNotNull() & ~F.isnan("ir")).distinct()
    slot = F.floor(F.col("ir") / M.SLOT)
    # a column of values a block, and the patterns as an array: the plan stays small whatever the radius
    value = F.array(*[F.struct(F.lit(i).alias("block"), v.alias("v"), F.array(*[F.lit(p).cast("long") for p in probes(w, bits)]).alias("masks")) for i, (v, w) in enumerate(zip(M.blocks(F.col("ip"), widths), widths))])
    keys = asked.select("ip", "ir", F.inline(value)).select("ip", "ir", "block", F.col("v"), F.explode("masks").alias("mask"))
    x = F.lit(0).cast("long")
    for i in range(blocks):
        x = F.when(F.col("block") == i, M._listed(F.col("v").bitwiseXOR(F.col("mask")), i, slot)).otherwise(x)
    name = _table(spark, path)
    entries = spark.table(name)
    # the planner takes the probes for as few bytes as the rows they are made of, and would send them all through the driver
    found = M.shuffled(keys.select("ip", "ir", x.alias("x"))).join(entries, "x")
    found.schema  # resolved: the name isn't needed any more
    spark.sql(f"DROP TABLE {name}")
    return found


def search(incoming: DataFrame, path: str, stored: DataFrame) -> DataFrame:
    """in_id, cat_id, p_distance of incoming rows and stored rows that are accepted now; stored is the catalogue that the index is of."""
    blocks = scheme_of(incoming.sparkSession, path)
    apart = F.col("ip").bitwiseXOR(F.col("cp"))
    pairs = met(incoming, path).filter(F.col("cr").between(F.col("ir") - M.BAND, F.col("ir") + M.BAND)).withColumn("p_distance", hamming64(F.col("ip"), F.col("cp")))
    pairs = pairs.filter((F.col("p_distance") < M.SEARCH) & (F.col("block") == M._first_block(list(WIDTHS[blocks]), radius(blocks))))
    # an entry that was added twice counts once
    pairs = cut(pairs.select("ip", "ir", "cp", "cr", "p_distance").distinct(), "hash-pairs")
    a = incoming.select(F.col("doc_id").alias("in_id"), F.col("p_hash").alias("ip"), F.col("ratio").cast("double").alias("ir"))
    b = M.accepted(stored).select(F.col("doc_id").alias("cat_id"), F.col("p_hash").alias("cp"), F.col("ratio").cast("double").alias("cr"))
    return pairs.join(M.shuffled(a), ["ip", "ir"]).join(M.shuffled(b), ["cp", "cr"]).select("in_id", "cat_id", "p_distance")
