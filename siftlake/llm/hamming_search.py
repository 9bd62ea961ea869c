"""Approximate nearest neighbours by inner product: multi-index hashing over learned binary codes.

Codes: vectors are raised by one coordinate, sqrt(M^2 - |x|^2) (queries: 0), which turns
inner products into angles, then projected on principal axes and rotated; the rotation is
learned by alternating signs and an orthogonal fit on a sample drawn by a hash of the id
(``sample`` expected). The sign of each coordinate is a bit; with more bits than dimensions
further learned rotations add theirs.

Index: each data block cuts its codes into substrings and holds, for each, the rows of every
value. A query probes, in each substring, all values within the radius that the pigeonhole
principle asks for, so the union holds every code within the whole radius; candidates within
it are reranked by the exact inner product. The radius is set so that a sample of queries,
searched exactly against all rows, finds ``aim`` of its true neighbours. A block with fewer
than k codes within the radius gives its k nearest codes instead, so that a query always
gets k rows where there are k.

Blocks: rows are dealt by a hash of the id into blocks of about ``block``; queries are dealt
into blocks likewise and every query block meets every data block.

Defined results: null ids and vectors that are null, empty, zero or hold null or non-finite
components take no part; a row with the query's own id is never its candidate; rows are
numbered, and repeated rows of other ids are candidates each; equal query rows are one query,
and of several vectors of a query id the best score of a candidate counts; ties go to the
smaller id; vectors of another length than the most common one take no part; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, vectors

SUBSTRING = 8


def learn_rotations(x: np.ndarray, bits: int, rounds: int = 20, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """mean, and a projection of dims x bits made of learned orthogonal blocks."""
    mean = x.mean(0)
    y, rng, blocks = x - mean, np.random.default_rng(seed), []
    _, axes = np.linalg.eigh(y.T @ y)
    while sum(b.shape[1] for b in blocks) < bits:
        width = min(x.shape[1], bits - sum(b.shape[1] for b in blocks))
        basis = axes[:, ::-1][:, :width]
        z = y @ basis
        r, _ = np.linalg.qr(rng.standard_normal((width, width)))
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(z @ r).T @ z)
            r = (u @ vt).T
        blocks.append(basis @ r)
    return mean, np.hstack(blocks)


def raise_to(x: np.ndarray, m2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, m2 - (x * x).sum(1)))[:, None]])


def encode(raised: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as rows of bytes, a substring each."""
    return np.packbits((raised - mean) @ projection > 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    wide = codes.view(np.uint64) if codes.shape[1] % 8 == 0 else codes
    return np.bitwise_count(wide ^ (code.view(np.uint64) if codes.shape[1] % 8 == 0 else code)).sum(1, dtype=np.int64)


_WEIGHT = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None])


class SubstringIndex:
    """Inverted lists of one block: for each substring, rows sorted by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]
        self.lists: dict = {}

    def probe(self, j: int, value: int, radius: int) -> np.ndarray:
        """Rows whose substring j is within radius of value."""
        if (j, value, radius) not in self.lists:
            s, o = self.starts[j], self.order[j]
            near = np.flatnonzero(_WEIGHT[value] <= radius)
            self.lists[j, value, radius] = np.concatenate([o[s[v] : s[v + 1]] for v in near])
        return self.lists[j, value, radius]

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Every row within the radius, and its distance."""
        m = self.codes.shape[1]
        low, more = divmod(radius, m)  # of m substrings, one is within low, or one of the first `more` + 1 is
        seen = np.zeros(len(self.codes), bool)
        for j in range(m):
            r = low if j <= more else low - 1
            if r >= 0:
                seen[self.probe(j, int(code[j]), r)] = True
        rows = np.flatnonzero(seen)
        d = distances(self.codes[rows], code)
        return rows[d <= radius], d[d <= radius]


def _search(mean, projection, m2: float, radius: int, k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            x, ids, numbers = vectors.matrix(rows["vec"]), rows["id"].to_numpy(), rows["row"].to_numpy()
            q, qids = vectors.matrix(queries["vec"]), queries["id"].to_numpy()
            index = SubstringIndex(encode(raise_to(x, m2), mean, projection))
            codes = encode(np.hstack([q, np.zeros((len(q), 1))]), mean, projection)
            # grouped by code, queries share inverted lists
            for i in range(len(q)):
                near, _ = index.within(codes[i], radius)
                near = near[ids[near] != qids[i]]
                if len(near) < k:
                    others = np.flatnonzero(ids != qids[i])
                    near = others[np.argsort(distances(index.codes[others], codes[i]), kind="stable")[: 4 * k]]
                scores = x[near] @ q[i]
                at = vectors.best(ids[near], scores, k)
                out.append((np.full(len(at), qids[i]), ids[near][at], numbers[near][at], scores[at]))
        if not out:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "row": np.empty(0, np.int64), "score": np.empty(0)})
        return pd.DataFrame({n: np.concatenate([o[c] for o in out]) for c, n in enumerate(("query_id", "vec_id", "row", "score"))})

    return run


def _exact(q: np.ndarray, qids: np.ndarray, mean, projection, m2: float, k: int):
    """Per task and sample query: its k best rows with their code distances."""

    def run(batches):
        codes = encode(np.hstack([q, np.zeros((len(q), 1))]), mean, projection)
        for pdf in batches:
            x, ids = vectors.matrix(pdf["vec"]), pdf["id"].to_numpy()
            own = encode(raise_to(x, m2), mean, projection)
            for i in range(len(q)):
                s = np.where(ids == qids[i], -np.inf, x @ q[i])
                at = vectors.best(ids, s, k)
                at = at[s[at] > -np.inf]
                yield pd.DataFrame({"query_id": qids[i], "vec_id": ids[at], "score": s[at], "distance": distances(own[at], codes[i])})

    return run


def search(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, bits: int = 128, sample: int = 5000, probes: int = 64, aim: float = 0.95, block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row where is_query holds (a condition on ``id``)."""
    spark = table.sparkSession
    rows = vectors.usable(table, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # written, the numbers stay as they are
    rows = common.cut(rows.filter(F.size("vec") == lengths["n"]).withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    norm2 = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    stats = rows.agg(F.count("*").alias("n"), F.max(norm2).alias("m2"), F.count_if(is_query).alias("q")).first()
    n, m2 = stats["n"], float(stats["m2"])
    draw = F.pmod(F.xxhash64("id", F.lit("rotation")), F.lit(1 << 30)) / float(1 << 30)
    fit = rows.filter(draw < sample / n).select("id", "vec").orderBy("id").toPandas()
    mean, projection = learn_rotations(raise_to(vectors.matrix(fit["vec"]), m2), bits) if len(fit) else (np.zeros(lengths["n"] + 1), np.eye(lengths["n"] + 1, bits))
    tried = rows.filter(is_query & (draw < probes / max(1, stats["q"]))).orderBy("id").toPandas()
    radius = bits // 4
    if len(tried):
        exact = rows.mapInPandas(_exact(vectors.matrix(tried["vec"]), tried["id"].to_numpy(), mean, projection, m2, k), "query_id long, vec_id long, score double, distance long")
        best = exact.withColumn("rank", F.row_number().over(_by_score())).filter(F.col("rank") <= k)
        radius = int(best.agg(F.percentile("distance", F.lit(aim))).first()[0] or radius) + 1

    blocks, sheets = max(1, -(-n // block)), max(1, -(-stats["q"] // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)))
    data = dealt.withColumn("sheet", F.explode(F.sequence(F.lit(0), F.lit(sheets - 1))))
    asked = rows.filter(is_query).select("id", "vec").distinct().withColumn("sheet", F.pmod(F.xxhash64("id", F.lit("sheet")), F.lit(sheets)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = data.groupBy("block", "sheet").cogroup(asked.groupBy("block", "sheet")).applyInPandas(_search(mean, projection, m2, radius, k), "query_id long, vec_id long, row long, score double")
    # a candidate is found once for each vector of the query
    best = found.groupBy("query_id", "row").agg(F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
    return vectors.merge(best, k, "double")


def _by_score():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
