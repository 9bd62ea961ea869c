"""The feature cache, layered settings, saved queries and the batch scorer on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftlake.functions.settings import layered
from siftlake.operators import saved as Q
from siftlake.plans.jobs import scored_batches
from siftlake.sources import feature_cache as C
from siftlake.sources.shared import new_dir


def test_the_cache_of_features(spark):
    day = lambda n: dt.datetime(2020, 1, n)
    files = [
        ("hit", day(2), "IMAGE", "/now"), ("same time", day(5), "IMAGE", "/now"), ("older", day(6), "IMAGE", "/now"), ("version", day(1), "IMAGE", "/now"),
        ("none", day(1), "IMAGE", "/now"), ("no hash", day(1), "IMAGE", "/now"), ("no image", day(1), "TEXT", "/now"), ("own", day(1), "LOCK", "/now"), ("null type", day(1), None, "/now"),
    ]
    files = spark.createDataFrame(files, "path string, modified timestamp, type string, from_path string")
    row = lambda path, version="2", d="cd": (path, version, "WAS", "/was", "ch", d, day(5))
    cached = [row("hit"), row("same time"), row("older"), row("version", "1"), row("no hash", d=None), row("no image", d=None), row("own"), row("gone")]
    cached = spark.createDataFrame(cached, "path string, version string, type string, from_path string, hash string, d_hash string, cached_at timestamp")
    asked = []
    compute = lambda rows: rows.select("path", F.lit("nh").alias("hash"), F.lit("nd").alias("d_hash"))
    second = lambda rows: asked.append(rows) or rows.select("path", F.lit("nd").alias("d_hash"))
    got = {r.path: (r.origin, r.hash, r.d_hash, r.type, r.from_path) for r in C.reuse(files, cached, "2", compute, second, F.col("type") == "IMAGE", ["from_path"]).collect()}
    new, hit = ("computed", "nh", "nd", "IMAGE", "/now"), ("cache", "ch", "cd", "IMAGE", "/now")
    assert got == {
        "hit": hit, "same time": hit, "older": new, "version": new, "none": new, "no hash": ("filled", "ch", "nd", "IMAGE", "/now"),
        "no image": ("cache", "ch", None, "TEXT", "/now"), "own": ("own", None, None, "LOCK", "/now"), "null type": ("computed", "nh", "nd", None, "/now"),
    }
    assert [r.path for r in asked[0].collect()] == ["no hash"]
    off = C.reuse(files, None, "2", compute, second, F.col("type") == "IMAGE", ["from_path"]).collect()
    assert {r.origin for r in off} == {"computed", "own"} and len(off) == 9


def test_the_newest_cached_row_counts(spark):
    folder = new_dir(spark, "cache")
    for h in ("first", "second"):
        C.write(spark.createDataFrame([("a", h)], "path string, hash string"), folder, "1")
    (row,) = C.read(spark, folder, "hash string").collect()
    assert (row.path, row.version, row.hash) == ("a", "1", "second") and row.cached_at is not None


def test_layers_of_settings(spark):
    rules = [
        (1, "path", "a", "x", "1", False), (2, "path", "ab", "x", "2", False), (3, "path", "a", "flag", "true", False), (4, "type", "T", "x", "3", False),
        (5, "path", "forced", "x", "4", True), (6, "type", "F", "x", "5", True), (0, "path", "", "name", "any", False),
    ]
    rules = spark.createDataFrame(rules, "place int, kind string, match string, setting string, value string, forced boolean")
    rows = [("zzz", "-"), ("a", "-"), ("ab", "-"), ("ab", "T"), ("ab forced", "T"), ("ab forced", "F"), (None, None)]
    found = layered(rules, F.col("p"), F.col("t"), {"x": 0, "flag": False, "name": "none", "rate": 0.5})
    got = spark.createDataFrame(rows, "p string, t string").select(*[c.alias(n) for n, c in found.items()]).collect()
    assert [r.x for r in got] == [0, 1, 2, 3, 4, 5, 0]
    assert [r.flag for r in got] == [False, True, True, True, True, True, False] and [r.name for r in got] == ["any"] * 6 + ["none"] and got[0].rate == 0.5
    with pytest.raises(ValueError):
        layered(rules, F.col("p"), F.col("t"), {"x": 0})


def test_saved_queries_are_kept_by_id(spark):
    saved = spark.createDataFrame([], Q.SCHEMA)
    saved = Q.put(saved, "1", "a", "SELECT 1 AS n")
    saved = Q.put(saved, "1", "b", "SELECT 2 AS n")
    saved, new = Q.post(saved, "c", "SELECT sum(n) AS n FROM {t}")
    assert {(r.id, r.name) for r in saved.collect()} == {("1", "b"), (new, "c")} and Q.get(saved, "1").first().sql == "SELECT 2 AS n" and Q.get(saved, "9").isEmpty()
    assert Q.run(saved, "c", t=spark.range(4).withColumnRenamed("id", "n")).first().n == 6
    saved, was = Q.delete(saved, "1")
    assert was and Q.delete(saved, "1")[1] is False and saved.count() == 1
    for call in (lambda: Q.run(saved, "b"), lambda: Q.put(saved, "no id!", "x", "SELECT 1")):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize(
    ("sql", "fine"),
    [
        ("WITH x AS (SELECT a FROM t WHERE a > 1) SELECT a, count(*) AS n FROM x GROUP BY a HAVING count(*) > 0 ORDER BY n LIMIT 3", True),
        ("SELECT * FROM t JOIN (SELECT max(a) AS a FROM t) USING (a) WHERE a IN (SELECT a FROM t) UNION ALL SELECT 1", True),
        ("SELECT a, row_number() OVER (PARTITION BY a ORDER BY a) FROM t", True),
        ("SELECT ';' AS a", True),
        ("DROP TABLE t", False),
        ("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", False),
        ("CREATE TABLE u AS SELECT 1", False),
        ("SELECT * FROM other", False),
        ("SELECT * FROM t WHERE a IN (SELECT a FROM other)", False),
        ("SELECT * FROM parquet.`/etc`", False),
        ("SELECT reflect('java.lang.System', 'exit', 1)", False),
        ("SET x = 1", False),
        ("SELECT 1; SELECT 2", False),
        ("nonsense", False),
    ],
)
def test_only_reading_queries_over_given_tables_run(spark, sql, fine):
    if fine:
        Q.check(spark, sql, {"t"})
    else:
        with pytest.raises(ValueError):
            Q.check(spark, sql, {"t"})


def test_a_failing_row_fails_alone(spark):
    def load():
        def score(texts):
            if (texts == "bad").any():
                raise KeyError("bad")
            return [len(t) if t != "nan" else float("nan") for t in texts]

        return score

    texts = ["a", "bb", "bad", "ccc", "nan", "bad", "dddd"]
    got = scored_batches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), load, 7).collect()
    want = {0: 1.0, 1: 2.0, 2: None, 3: 3.0, 4: None, 5: None, 6: 4.0}
    assert {r.doc_id: r.score for r in got} == want and all(r.state == (1 if want[r.doc_id] is None else 2) and r.version == 7 for r in got)
