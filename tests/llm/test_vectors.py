import numpy as np
from pyspark.sql import functions as F

from siftlake.llm import hamming_search, pivot_search


def table(spark, n=700, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    x[10:40] = x[10]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [None] * 16), (1003, [float("nan")] * 16), (1004, [0.0] * 16), (None, [1.0] * 16)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), x.astype(float)


def test_pivot_search_is_exact(spark):
    df, x = table(spark)
    got = pivot_search.top_k(df, F.col("id") % 100 == 0, k=5, pivots=8, annulus=40).toPandas()
    whole = np.vstack([np.floor(1024 * x), np.zeros((1, 16))]).astype(np.int64)
    ids = np.array([*range(700), 1004])
    for q in ids[ids % 100 == 0]:
        s = whole @ whole[list(ids).index(q)]
        expect = [(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
        own = got[got.query_id == q].sort_values("rank")
        assert list(zip(own.vec_id, own.score)) == expect
    assert pivot_search.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_hamming_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (400, 4), dtype=np.uint8)
    index = hamming_search.SubstringIndex(codes)
    for radius in (0, 3, 9, 14):
        for i in range(0, 400, 40):
            rows, _ = index.within(codes[i], radius)
            assert set(rows) == set(np.flatnonzero(np.bitwise_count(codes ^ codes[i]).sum(1) <= radius))


def test_hamming_search_recall(spark):
    df, x = table(spark)
    got = hamming_search.search(df, F.col("id") % 20 == 0, k=10, bits=64, block=300).toPandas()
    hit = n = 0
    for q in range(0, 700, 20):
        s = x @ x[q]
        s[q] = -np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert len(own) == 10 and np.allclose(own.score, s[own.vec_id])
        # of equal scores at the edge any will do
        hit, n = hit + (own.score >= np.sort(s)[-10] - 1e-9).sum(), n + 10
    assert hit / n >= 0.9
    assert 1004 not in set(got.vec_id)
    assert hamming_search.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_pivot_groups_are_bounded_on_both_sides(spark, monkeypatch):
    df, _ = table(spark)
    whole = sorted(pivot_search.top_k(df, F.col("id") % 4 == 0, k=5, pivots=8, annulus=40).collect())
    visit = pivot_search._visit

    def watched(m2, k):
        run = visit(m2, k)

        def held(key, rows, queries):
            assert len(queries) <= 40, len(queries)
            return run(key, rows, queries)

        return held

    monkeypatch.setattr(pivot_search, "_visit", watched)
    assert sorted(pivot_search.top_k(df, F.col("id") % 4 == 0, k=5, pivots=8, annulus=40, sheet=20).collect()) == whole


def test_repeated_rows_are_candidates_each(spark):
    df, _ = table(spark, 120)
    again = df.filter("vec_id in (33, 40)")
    docs = df.union(again).union(again).union(again).withColumn("row", F.lit("x")).withColumn("score", F.lit(1)).withColumn("pivot", F.lit(2))
    for got, k in ((hamming_search.search(docs, F.col("id") % 20 == 0, k=200, bits=32), 200), (pivot_search.top_k(docs, F.col("id") % 20 == 0, k=200, pivots=4, annulus=30), 200)):
        own = got.filter("query_id = 60").toPandas()
        assert sorted(own["rank"]) == list(range(1, len(own) + 1))
        assert (own.vec_id == 33).sum() == (own.vec_id == 40).sum() == 4 and (own.vec_id == 41).sum() == 1
        assert (own.vec_id == 60).sum() == 0
        # the query that comes four times is one query, and none of its rows is its own candidate
        mine = got.filter("query_id = 40").toPandas()
        assert len(mine) == len(own) - 3 and (mine.vec_id == 40).sum() == 0 and (mine.vec_id == 33).sum() == 4


def test_large_components_are_an_error(spark):
    import pytest

    docs = spark.createDataFrame([(0, [1e300, 0.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="63 bits"):
        pivot_search.top_k(docs, F.col("id") % 100 == 0).collect()


def test_annuli_split_into_pieces(spark):
    df, _ = table(spark)
    docs = df.filter("vec_id between 10 and 39 or vec_id = 100")  # 30 equal vectors, one pivot, one distance
    got = pivot_search.top_k(docs, F.col("id") % 100 == 0, k=30, pivots=1, annulus=4).toPandas()
    assert sorted(got.vec_id) == list(range(10, 40)) and got.score.nunique() == 1
