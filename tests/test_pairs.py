"""Near pairs meet each side once, and what is looked at one by one stays short."""

from pyspark.sql import functions as F

from siftlake.operators import judging as J
from siftlake.operators import matching as M

ROW = "doc_id long, d_hash long, size long, width long, height long, timestamp long, state long, from_path string, to_path string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_meet_each_side_once_and_end_by_incoming_row(spark):
    rows = spark.createDataFrame([(1, 0b111, 10, 10, 1, 5, 200, "/in/a/x.txt", None), (2, None, 10, 10, 1, 6, 200, "/in/b/y.txt", None)], ROW)
    stored = spark.createDataFrame([(7, 0b001, 10, 10, 1, 3, 200, "/in/a/z.txt", "/lib/z.txt"), (8, 0, 10, 30, 1, 3, 300, "/in/c/u.txt", "/lib/u.txt")], ROW)
    listing = stored.select("to_path").limit(1)
    statistics = spark.createDataFrame([(1, 90.0, 4.0, 50.0), (7, 90.0, 4.0, 50.0)], "doc_id long, mean double, entropy double, quality double")
    pairs = spark.createDataFrame([(1, 7, 1), (1, 8, 4), (2, 7, 2)], "in_id long, cat_id long, p_distance int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = J.candidates(pairs, rows, stored, listing, statistics)
        verdicts = J.near_verdicts(J.remapped(J.judged(found)))
        # the pairs are dealt by incoming row once: the grouping finds them there
        assert plan(verdicts).count("Exchange hashpartitioning(in_id") == 1
        assert {(r.in_id, r.cat_id): (r.d_distance, r.valid, r.same_dir, r.small_pixel, r.keeping) for r in found.collect()} == {(1, 7): (2, True, True, False, False), (1, 8): (3, True, False, True, True), (2, 7): (None, False, False, False, False)}
        assert {r.in_id: (r.action, r.hit_id, r.reason) for r in verdicts.collect()} == {1: ("delete", 7, "TYPE_P_HASH_REJECT_NEWER"), 2: ("hold", None, "TYPE_P_HASH_MAY_BE")}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_probes_are_not_one_long_expression(spark):
    """A row's 70 keys in one expression were too long for the compiler of the running code."""
    rows = spark.createDataFrame([(1, 5, 5.0, 200)], "doc_id long, p_hash long, ratio double, state long")
    found = M.near_dup_multi_index(rows, rows.withColumn("p_hash", F.col("p_hash").bitwiseXOR(F.lit(1023).cast("long"))))
    assert max(len(line) for line in plan(found).splitlines()) < 4000
    assert [tuple(r) for r in found.collect()] == [(1, 1, 10)]
