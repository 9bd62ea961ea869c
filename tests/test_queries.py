import glob
import os

import duckdb
import pytest

from siftlake.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Those whose SQL needs similarity hashes take DuckDB ten seconds each; of them these, which hold all the others' steps, are tested here.
SLOW = ["near_dup_search", "near_dup_index", "near_dup_exact_tier", "near_dup_verdict", "candidate_statistics", "judge_batch", "apply_mutations", "state_cascade", "fill_required_hashes", "repair_hashes"]
NEAR = ("FROM near", "FROM sim", "JOIN sim", "FROM jd", "FROM fac", "FROM ver", "FROM rem2", "FROM nv", "FROM mp", "FROM mv", "FROM al", "FROM ins")
QUICK = sorted(n for n, sql in ORACLES.items() if not any(x in sql.split("bit_count(xor(n.p, c.p)) < 11)")[-1] for x in NEAR))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", QUICK + SLOW)
def test_rows_equal_the_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    sql = duck.sql(ORACLES[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


def test_stream_equals_batch(spark):
    whole = lambda name: {(r.in_id, r.action, r.hit_id, r.reason) for r in QUERIES[name](spark, SF).collect()}
    assert whole("judge_batch") == whole("stream_ingest_judge")


def test_backlog_is_drained_up_to_a_limit(spark):
    from siftlake.streaming.ingest import drained

    got = drained(spark, spark.range(95).withColumnRenamed("id", "k"), 10, "k", most=7).collect()
    assert sorted((r.k, r.batch) for r in got) == [(k, k // 10) for k in range(70)]
    assert drained(spark, spark.range(0).withColumnRenamed("id", "k"), 10, "k").count() == 0


@pytest.mark.parametrize("name", ["mark_verdict", "judge_batch", "candidate_factors", "mutation_plan"])
def test_texts_are_split_before_the_last_plan(spark, name):
    assert "text" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_split_in_one_scan(spark, monkeypatch):
    from siftlake.sources import fixtures as X

    read, table = [], X.table
    monkeypatch.setattr(X, "table", lambda spark, sf_dir, name: read.append(name) or table(spark, sf_dir, name))
    QUERIES["judge_batch"](spark, SF)
    assert read.count("documents") == 1


def test_hashes_are_filled_from_the_one_pass_over_the_texts(spark, monkeypatch):
    from siftlake.sources import fixtures as X

    read, table = [], X.table
    monkeypatch.setattr(X, "table", lambda spark, sf_dir, name: read.append(name) or table(spark, sf_dir, name))
    QUERIES["fill_required_hashes"](spark, SF)
    assert read.count("documents") == 1


def test_pairs_meet_each_side_once(spark):
    """Pairs grow faster than rows: two joins a pair, and no path is cut for a pair."""
    plan = QUERIES["candidate_factors"](spark, SF)._jdf.queryExecution().optimizedPlan()
    assert "regexp_extract" not in plan.toString().split("\n")[0]
    joins = 0
    while plan.children().size():
        joins += plan.nodeName() == "Join"
        plan = plan.children().apply(0)
    assert joins == 2
