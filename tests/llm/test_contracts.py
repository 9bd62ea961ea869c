"""What the contracts fix of op3 and op6, recomputed by hand."""

import re
import zlib
from collections import defaultdict

import pytest

from siftlake.llm import queries
from siftlake.llm.mixing import cube_mix


def targets(rows):
    """source -> (its size, its target): shares by weight, cut at three times the size, the excess reshared until none is above."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(size.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * size[s]}
        if not above:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in above}
        free -= above
    return {s: (size[s], target[s]) for s in order}


@pytest.mark.parametrize("tiny", [3, 40])
def test_targets_with_the_cap_in_force(spark, tiny):
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, text(20 + i % 7), "huge") for i in range(400)] + [(1000 + i, text(5), "a") for i in range(tiny)] + [(2000 + i, text(11), None) for i in range(60)]
    rows += [(3000 + i, text(9), "b") for i in range(25)] + [(4000, None, "a"), (4001, "", "b"), (4002, text(8), "é")]
    want = targets(rows)
    assert any(t == 3.0 * n for n, t in want.values()) and any(t < 3.0 * n for n, t in want.values())
    got = cube_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source, words, taken = {r[0]: r[2] for r in rows}, {r[0]: len((r[1] or "").split()) for r in rows}, defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        n, target = want[source[r.doc_id]]
        assert (r["size"], r.source_size) == (words[r.doc_id], n) and r.target == pytest.approx(target) and 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s, (n, target) in want.items():
        assert abs(taken[s] - target) <= max(0.03 * target, 30)


def test_language_folds_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()}
    got = queries.QUERIES["op6_language_id"](spark, sf).collect()
    assert {r.doc_id for r in got} == docs.keys() and len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    letters = lambda t: t is not None and any(c.isalpha() for c in t)
    held = [r for r in got if r.held_out and letters(docs[r.doc_id].text) and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held) > 200
    assert all(r.lang_pred == "und" for r in got if not letters(docs[r.doc_id].text))
