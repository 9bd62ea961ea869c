"""Mixing sources to target weights by the cube method.

A source with target t and size s gets rate r = t / s: every document is taken floor(r)
times, and once more with inclusion probability r - floor(r). The flight phase moves these
probabilities along the null space of two balance constraints, the words and the number of
documents of the source: with three documents still open there is one free direction, and a
step along it settles at least one of them while both sums stay as they are. Blocks of
bounded size fly in parallel, and in each a dozen documents of geometrically spaced size ranks
sit the flight out. They and what it leaves open (two documents at most) meet in the next
level's blocks, until the source has one block left, whatever the sizes of the others. There
they are the landing problem: of all outcomes the one closest to both totals is taken. (With only two documents
to land, one very long document would decide the error.)

Random choices come from hashes of the rows, so reruns agree.

Defined results: null text has size 0 and is never taken with effect; a null source is a
source of its own, last in order; documents of equal id and size are interchangeable; a
source of size 0 has target 0; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

EPS = 1e-9
#: Documents of a block kept out of its flight for the landing.
LANDING = 12


def words(column: str = "text") -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(column, F.lit(common.WORD)), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """target of each row of sources(source, source_size): weights repeat over the ordered sources, share the
    whole size, and stop at ``most`` times a source's size; the excess goes to the others by weight.

    The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    below = fill.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    # sources fill up in the order of cap / weight; the level is what the rest share by weight once the full ones are paid
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    ranked = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", level)
    # the first source whose cap is above its level, and all after it, stay at that level
    open_ = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull().alias("null"), "source", "level"))).over(everywhere)["level"]
    return ranked.withColumn("target", F.least("cap", F.coalesce(open_, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "target")


def fly(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: probabilities of which two at most are strictly between 0 and 1, with sum(pi) and sum(pi * size) as before."""
    p, x = pi.tolist(), size.astype(float).tolist()
    draws = iter(rng.random(len(p) + 1).tolist())
    open_: list[int] = []
    for i, v in enumerate(p):
        if not EPS < v < 1 - EPS:
            p[i] = float(round(v))
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, d in zip(open_, u):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
        step = up if next(draws) < down / (up + down) else -down
        for k, d in zip(open_, u):
            p[k] += step * d
        left = []
        for k in open_:
            if EPS < p[k] < 1 - EPS:
                left.append(k)
            else:
                p[k] = float(round(p[k]))
        open_ = left
    return np.array(p)


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The landing: of all outcomes of the few open documents, the one nearest to their expected words, then documents."""
    at = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    outcomes = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    off = np.abs(outcomes @ size[at] - pi[at] @ size[at]) / max(1.0, size[at].max(initial=1.0))
    best = np.lexsort((np.arange(len(outcomes)), np.abs(outcomes.sum(1) - pi[at].sum()), off.round(9)))[0]
    out = pi.round()
    out[at] = outcomes[best]
    return out


def _block(block: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "size"], kind="stable").reset_index(drop=True)
        pi, size = pdf["pi"].to_numpy().copy(), pdf["size"].to_numpy().astype(float)
        fliers = np.ones(len(pi), bool)
        ranks = (1 << np.arange(LANDING)) - 1
        # small blocks have fewer such ranks: others spread over the rest fill up
        ranks = ranks[ranks < len(pi)]
        rest = np.setdiff1d(np.arange(len(pi)), ranks)
        ranks = np.concatenate([ranks, rest[np.linspace(0, len(rest) - 1, min(len(rest), LANDING - len(ranks))).astype(int)]])
        fliers[np.argsort(-size, kind="stable")[ranks]] = False
        mixed = [seed, len(pdf), int(pdf["h"].iloc[0]) & 0xFFFFFFFF]
        pi[fliers] = fly(pi[fliers], size[fliers], np.random.default_rng(mixed))
        pdf["pi"] = land(pi, size) if pdf["n"].iloc[0] <= block else pi
        return pdf

    return run


def cube_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, block: int = 20_000, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and copies (times taken) for docs(doc_id, source, text)."""
    spark, block = docs.sparkSession, max(block, 4 * (LANDING + 2))
    units = docs.select("doc_id", "source", words().alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.col("text").cast("binary"))).alias("h"))
    units = common.cut(units, "mix-units")
    sources = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = capped_targets(sources, weights, most).join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = common.cut(plan, "mix-targets")
    rate = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(float(most)))
    key = F.struct(F.col("source").isNull().alias("is_null"), F.coalesce("source", F.lit("")).alias("name"))
    # the join key carries no null, so that it can be hashed; one row a source on the right
    right = plan.select(F.xxhash64(key).alias("sk"), "source_size", "target", "n", rate.alias("rate"))
    rows = units.withColumn("sk", F.xxhash64(key)).join(right, "sk")
    whole = F.floor(F.col("rate") + EPS)
    rows = rows.withColumn("whole", whole.cast("long")).withColumn("pi", F.greatest(F.col("rate") - whole, F.lit(0.0)))

    settled = rows.filter(~((F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)))
    open_ = rows.filter((F.col("pi") > EPS) & (F.col("pi") < 1 - EPS))
    most_blocks = -(-(plan.agg(F.max("n")).first()[0] or 0) // block)
    done, level = [settled], 0
    while True:
        final = most_blocks <= 1
        blocks = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.lit(1))
        flown = open_.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), blocks)).groupBy("sk", "block").applyInPandas(_block(block, seed + level), open_.withColumn("block", F.lit(0).cast("long")).schema).drop("block")
        if final:
            done.append(flown)
            break
        flown = common.cut(flown, "mix-flown")
        still = (F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)
        done.append(flown.filter(~still))
        # a block left its landing documents and two at most; sources of one block have landed
        open_ = flown.filter(still).withColumn("n", F.ceil(F.col("n") / F.lit(block)) * (LANDING + 2))
        most_blocks, level = -(-(LANDING + 2) * most_blocks // block), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = F.col("whole") + F.round("pi").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies"))
