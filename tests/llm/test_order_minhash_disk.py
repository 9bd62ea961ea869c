"""What lies on disk at once: one slice's shuffles, and no rows dealt twice."""

import os

from siftlake.llm import common, order_minhash

TEXT = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, TEXT), (2, TEXT + " more"), (3, "other words"), *[(10 + i, f"{TEXT} end{i} of{i} it{i}") for i in range(40)], (100, None), (101, TEXT)]


def test_texts_are_sketched_in_slices_and_their_keys_go_slice_by_slice(spark, monkeypatch):
    cut_by, slices, there = common.cut_by, [], []

    def spied(df, key, name="step"):
        def watched():
            for t in df:
                there.append([os.path.exists(s._scratch) for s in slices])
                yield t

        if name == "words":
            return cut_by(watched(), key, name)
        slices.append(cut_by(df, key, name))
        return slices[-1]

    monkeypatch.setattr(common, "cut_by", spied)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()}
    assert got == {i: 1 if i not in (3, 100) else i for i, _ in ROWS}
    assert there == [[True, True], [False, True]]


def test_keys_are_dealt_once_for_count_and_join(spark, monkeypatch):
    cut, plans = common.cut, {}

    def spied(df, name="step", parts=()):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name, parts)

    monkeypatch.setattr(common, "cut", spied)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        order_minhash.near_duplicates(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all("ReusedExchange" in p for name in ("shared-keys", "buckets") for p in plans[name])
    assert len(plans["met"]) > 1
