"""Free names against a row-at-a-time simulation."""

import random

import pytest

from siftlake.operators.naming import running_total, without_collisions


def simulated(wanted, taken):
    used, out = set(taken), []
    for path in wanted:
        final, i = path, 0
        while final in used:
            i += 1
            final = f"{path}_{i}"
        used.add(final)
        out.append(final)
    return out


def given(spark, wanted, taken=()):
    rows = spark.createDataFrame(list(enumerate(wanted)), "id int, base string")
    got = without_collisions(rows, spark.createDataFrame([(t,) for t in taken], "to_path string"), "base", "id").collect()
    return [r.final_path for r in sorted(got, key=lambda r: r.id)]


@pytest.mark.parametrize(
    ("wanted", "taken"),
    [
        (["a", "a", "a_1"], []),
        (["a_1", "a", "a", "a_1", "a_1_1", "a_1"], []),
        (["a", "a", "a_2", "a", "a_01", "a_0", "a"], ["a", "a_2"]),
        (["a_1_1", "a_1", "a", "a", "a_1", "a"], ["a_3", "other"]),
    ],
)
def test_overlapping_families(spark, wanted, taken):
    got = given(spark, wanted, taken)
    assert got == simulated(wanted, taken)
    assert len({*got, *taken}) == len(got) + len(taken)


def test_random_rows_equal_the_simulation(spark):
    rng = random.Random(3)
    names = ["a", "b", "a_1", "a_2", "a_1_1", "a_1_2", "b_7", "a_10", "", "_1"]
    wanted = rng.choices(names, [30, 5, 8, 8, 5, 5, 3, 2, 2, 2], k=300)
    taken = ["a", "a_5", "b_1", "a_1_1", "b_7_3"]
    assert given(spark, wanted, taken) == simulated(wanted, taken)


def test_without_rows(spark):
    assert given(spark, []) == []


def test_running_totals_span_ranges(spark):
    rows = spark.createDataFrame([("hot", i, 1 + i % 3) for i in range(500)] + [("b", 1, 7), ("b", 2, 1)], "k string, o int, v int")
    from pyspark.sql import functions as F

    got = {(r.k, r.o): r.t for r in running_total(rows, "k", "o", F.col("v"), "t").collect()}
    total = 0
    for i in range(500):
        assert got["hot", i] == total
        total += 1 + i % 3
    assert (got["b", 1], got["b", 2]) == (0, 7)
