"""Exact top-k by inner product over a pivot-distance index.

Vectors become whole numbers, floor(scale * x). One more coordinate, sqrt(M^2 - |x|^2) for
vectors and 0 for queries, turns the largest inner product into the smallest Euclidean
distance: d^2 = |q|^2 + M^2 - 2 q.x.

Every vector is keyed by its nearest pivot and its distance to it. Sorted by distance, a
pivot's vectors fall into annuli of bounded size. By the triangle inequality no vector of an
annulus [lo, hi] around p is nearer to q than max(0, d(q,p) - hi, lo - d(q,p)). Each query
first searches the annulus of least bound, which gives it a k-th distance; it then visits
every annulus whose bound does not exceed that distance, and there only the slice of
distances within it, nearest first, stopping as the k-th distance shrinks. Scores are exact
integers; the bounds get a small slack for rounding. The visits of an annulus are split by a
hash of the query into sheets of ``sheet`` expected queries, each with a copy of the annulus, so
that a group is bounded on both sides.

Pivots are a sample drawn by a hash of the id (``pivots`` expected), and a pivot has 64 annuli
at most, so the table of annuli (four numbers each) that goes to every task is bounded. An
annulus of more than ``annulus`` rows is split by a hash of the id into pieces that its queries
all visit.

Defined results: null ids, null or empty vectors and vectors with null or non-finite
components take no part; a finite vector whose whole numbers could leave 63 bits in an inner
product is an error; a row with the query's own id is never its candidate; repeated rows of other ids
are candidates each; fewer than k candidates are all returned; vectors of another length
than the most common one take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

SLACK = 1e-9


def _key(pivots: np.ndarray):
    """Nearest pivot and distance of each vector in the raised space; pivots: rows with the added coordinate."""

    def run(batches):
        for pdf in batches:
            x = vectors.matrix(pdf["v"])
            raised = np.hstack([x, np.sqrt(np.maximum(0, pdf["m2"].to_numpy() - (x * x).sum(1)))[:, None]])
            d2 = (raised**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * raised @ pivots.T
            near = d2.argmin(1)
            dist = np.linalg.norm(raised - pivots[near], axis=1)
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "pivot": near, "dist": dist})

    return run


def _query_bounds(pivots: np.ndarray, annuli: np.ndarray, m2: float, first: bool):
    """(query, annulus) visits: the annulus of least bound at first, then all others not beyond the k-th distance."""
    number, pivot, lo, hi = annuli[:, 0].astype(int), annuli[:, 1].astype(int), annuli[:, 2], annuli[:, 3]

    def run(batches):
        for pdf in batches:
            q = vectors.matrix(pdf["v"])
            raised = np.hstack([q, np.zeros((len(q), 1))])
            to_pivot = np.sqrt(np.maximum(0, (raised**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * raised @ pivots.T))
            d = to_pivot[:, pivot]
            bound = np.maximum(0, np.maximum(d - hi, lo - d))
            start = bound.argmin(1)
            for i in range(len(q)):
                if first:
                    at = start[i : i + 1]
                else:
                    at = np.flatnonzero(bound[i] <= pdf["kth"].iloc[i] * (1 + SLACK) + SLACK)
                    at = at[at != start[i]]
                if len(at):
                    yield pd.DataFrame({"query_id": pdf["query_id"].iloc[i], "q": [pdf["v"].iloc[i]] * len(at), "kth": np.inf if first else pdf["kth"].iloc[i], "to_pivot": d[i, at], "annulus": number[at]})

    return run


def _visit(m2: float, k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows = rows.sort_values("dist")
            x, dist, ids = vectors.matrix(rows["v"]), rows["dist"].to_numpy(), rows["id"].to_numpy()
            for qid, qv, kth, to_pivot in zip(queries["query_id"], queries["q"], queries["kth"], queries["to_pivot"]):
                q = np.asarray(qv, float)
                reach = kth * (1 + SLACK) + SLACK
                a, b = np.searchsorted(dist, to_pivot - reach), np.searchsorted(dist, to_pivot + reach, "right")
                # whole numbers below 2^53 make this product exact in doubles; others are multiplied as integers
                exact = np.abs(x[a:b]).max(initial=0) * np.abs(q).max(initial=0) * len(q) < 2**53
                scores = (x[a:b] @ q).astype(np.int64) if exact else x[a:b].astype(np.int64) @ q.astype(np.int64)
                other = ids[a:b] != qid
                own_ids, scores = ids[a:b][other], scores[other]
                at = vectors.best(own_ids, scores, k)
                out.append(pd.DataFrame({"query_id": qid, "vec_id": own_ids[at], "score": scores[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, k: int = 10, pivots: int = 48, annulus: int = 8192, sheet: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest whole-number inner products for each row where is_query holds (a condition on ``id``)."""
    spark = table.sparkSession
    whole = F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x))
    rows = vectors.usable(table, id_col, vec_col)
    size = F.aggregate("vec", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    fits = size * scale < F.sqrt(F.lit(2.0**62) / F.size("vec")) - 1
    rows = rows.withColumn("vec", F.when(fits, F.col("vec")).otherwise(F.raise_error(F.lit("inner products of a vector don't fit 63 bits; take a smaller scale")))).select("id", whole.alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("v") == (lengths["n"] if lengths else 0))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    stats = rows.agg(F.count("*").alias("n"), F.max(norm2).alias("m2")).first()
    n, m2 = stats["n"], float(stats["m2"] or 0)
    draw = F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 30)) / float(1 << 30)
    drawn = [r["v"] for r in rows.filter(draw < pivots / max(1, n)).select("v").distinct().collect()] or [[0] * (lengths["n"] if lengths else 1)]
    centre = np.array(drawn, float)
    centre = np.hstack([centre, np.sqrt(np.maximum(0, m2 - (centre**2).sum(1)))[:, None]])

    kind = "id long, v array<long>, pivot int, dist double"
    keyed = common.cut(rows.withColumn("m2", F.lit(m2)).mapInPandas(_key(centre), kind), "pivot-keys")
    # annuli: a pivot's rows split by sampled distances into shares of `annulus` rows; equal distances are split by a hash
    counts = {r["pivot"]: r["count"] for r in keyed.groupBy("pivot").count().collect()}
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("dist", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(1000)).alias("at")).collect()
    edges = []
    for r in sorted(cuts, key=lambda r: r["pivot"]):
        want = -(-counts[r["pivot"]] // annulus)
        at = [r["at"][min(62, max(0, round(64 * i / want) - 1))] for i in range(1, min(want, 64))]
        edges += [(r["pivot"], j, float(lo), float(hi)) for j, (lo, hi) in enumerate(zip([-1.0, *sorted(set(at))], [*sorted(set(at)), float("inf")]))]
    slots = spark.createDataFrame(edges or [(0, 0, -1.0, float("inf"))], "pivot int, ring int, lo double, hi double")
    ring = keyed.join(F.broadcast(slots), "pivot").filter((F.col("dist") > F.col("lo")) & (F.col("dist") <= F.col("hi"))).drop("lo", "hi")
    sizes = ring.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    # at most 64 rings a pivot
    annuli = [(i, r["pivot"], r["ring"], -(-r["n"] // (2 * annulus)), r["lo"], r["hi"]) for i, r in enumerate(sizes.orderBy("pivot", "ring").collect())]
    if not annuli:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    names = spark.createDataFrame([a[:4] for a in annuli], "annulus int, pivot int, ring int, pieces long")
    placed = ring.join(F.broadcast(names), ["pivot", "ring"]).withColumn("piece", F.pmod(F.xxhash64("id", F.lit("piece")), F.col("pieces"))).select("annulus", "piece", "id", "v", "dist")
    known = np.array([(a[0], a[1], a[4], a[5]) for a in annuli])

    queries = keyed.filter(is_query).select(F.col("id").alias("query_id"), "v").distinct()
    visits = "query_id long, q array<long>, kth double, to_pivot double, annulus int"
    found = "query_id long, vec_id long, score long"

    def visited(plan: DataFrame) -> DataFrame:
        plan = common.cut(plan, "pivot-visits")
        sheets = plan.groupBy("annulus").agg(F.ceil(F.count("*") / F.lit(sheet)).alias("sheets")).join(F.broadcast(names.select("annulus", "pieces")), "annulus")
        asked = plan.join(sheets, "annulus").withColumn("sheet", F.pmod(F.xxhash64("query_id", F.lit("sheet")), F.col("sheets")))
        asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("sheets", "pieces")
        copies = placed.join(sheets, "annulus").withColumn("sheet", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sheets") - 1))).drop("sheets", "pieces")
        return copies.groupBy("annulus", "piece", "sheet").cogroup(asked.groupBy("annulus", "piece", "sheet")).applyInPandas(_visit(m2, k), found)

    start = common.cut(visited(queries.mapInPandas(_query_bounds(centre, known, m2, True), visits)), "pivot-first")
    kth = start.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("low"))
    q2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    reach = F.when(F.col("low").isNotNull(), F.sqrt(F.greatest(q2 + F.lit(m2) - 2 * F.col("low"), F.lit(0.0)))).otherwise(F.lit(float("inf")))
    bounded = queries.join(kth, "query_id", "left").select("query_id", "v", reach.alias("kth"))
    rest = visited(bounded.mapInPandas(_query_bounds(centre, known, m2, False), visits))
    return vectors.merge(start.unionByName(rest), k, "long")
