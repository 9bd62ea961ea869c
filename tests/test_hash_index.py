"""The stored hash index against all pairs."""

import random

import pytest

from siftlake.operators import hash_index as I
from siftlake.sources.shared import cut, new_dir

ROWS = "doc_id long, p_hash long, ratio double, state long"


def hashes(seed, n, first):
    rng = random.Random(seed)
    seeds, out = [random.Random(9).getrandbits(64) for _ in range(6)], []
    for i in range(n):
        h = rng.choice(seeds)
        for k in rng.sample(range(64), rng.randint(0, 14)):
            h ^= 1 << k
        h = rng.choice([h, h, h, None]) if i % 9 == 0 else h
        out.append((first + i, h if h is None or h < 1 << 63 else h - (1 << 64), rng.choice([1.0, 1.19, 1.2, 1.4, float("nan"), 3.0]), rng.choice([100, 200, 300])))
    return out + [(first + n, out[1][1], out[1][2], 200), (first + n + 1, out[1][1], out[1][2], 200)]


def all_pairs(incoming, stored):
    return sorted(
        (i, c, bin((a ^ b) & (1 << 64) - 1).count("1"))
        for i, a, r, _ in incoming
        for c, b, s, state in stored
        if state >= 200 and a is not None and b is not None and r - 0.2 <= s <= r + 0.2 and bin((a ^ b) & (1 << 64) - 1).count("1") < 11
    )


@pytest.mark.parametrize("blocks", [6, 4])
def test_no_pair_is_lost_or_doubled_and_changes_count(spark, blocks):
    incoming, stored = hashes(1, 60, 0), hashes(2, 80, 1000)
    path, make = new_dir(spark, "index"), lambda rows: spark.createDataFrame(rows, ROWS)
    I.create(make([(d, h, r, 200) for d, h, r, _ in stored[:60]]), path, blocks)
    I.add(make(stored[50:]), path)
    got = sorted(map(tuple, I.search(make(incoming), path, make(stored)).collect()))
    assert got == all_pairs(incoming, stored) and len(got) > 100


def test_blocks_widen_with_the_number_of_rows():
    found = [I.scheme(n) for n in (0, 1000, 50_000, 10**6, 10**9)]
    assert found[0] == 6 and found[-1] == 3 and found == sorted(found, reverse=True)
    assert all(sum(w) == 64 and len(w) == m for m, w in I.WIDTHS.items())
    assert len(I.probes(11, 1)) == 12 and len(I.probes(16, 2)) == 137


def test_probes_are_shuffled_and_not_sent_through_the_driver(spark):
    make = lambda rows: cut(spark.createDataFrame(rows, ROWS), "rows")
    incoming, stored, path = make(hashes(1, 60, 0)), make(hashes(2, 80, 1000)), new_dir(spark, "index")
    I.create(stored, path, 4)
    for found in (I.met(incoming, path), I.search(incoming, path, stored)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
