import hashlib
import re
import tempfile

from pyspark.sql import functions as F

from siftlake.functions import hashes as H
from siftlake.functions import numbers as N
from siftlake.functions import paths as P
from siftlake.functions import reasons as R
from siftlake.operators import judging as J
from siftlake.operators import matching as M
from siftlake.operators import merging as G
from siftlake.sources import fixtures as X


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_hamming_of_unsigned_text(spark):
    a, b = H.hash_from_text(F.lit("7856513260241168089")), H.hash_from_text(F.lit("7856513260241168085"))
    assert one(spark, H.hamming64(a, b)) == 2
    assert one(spark, H.hamming64(a, F.lit(None).cast("long"))) is None
    assert one(spark, H.hash_from_text(F.lit("18446744073709551615"))) == -1
    assert one(spark, H.hash_from_text(F.lit("18446744073709551616"))) is None
    assert one(spark, H.hash_from_text(F.lit("undefined"))) is None


def test_similarity_hashes(spark):
    """Bit by bit against the majority of the words' hashes; no words, no row."""
    texts = ["abc abc", "The quick brown fox, the lazy dog", "", "!!", " ".join(f"w{i}" for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in X.similarity_hashes(docs).collect()}
    assert sorted(got) == [0, 1, 4] and got[0].p_hash == one(spark, H.word_hash(F.lit("abc")))
    for i in got:
        words = set(re.findall(r"\w+", texts[i].lower()))
        for name, salt in X.SALTS.items():
            hashes = [int(hashlib.md5((salt + w).encode()).hexdigest()[:16], 16) for w in words]
            want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
            assert got[i][name] & (1 << 64) - 1 == want


def test_reasons(spark):
    tokens = {"TYPE_P_HASH_MATCH": "REPLACE", "TYPE_HASH_MATCH": "HASH_", "TYPE_P_HASH_REJECT_NEWER": "NEWER", "TYPE_P_HASH_MATCH_LOST_FILE": "LOST_FILE", "TYPE_FILE_NAME_MATCH": "FILE_NAME_"}
    assert {r: one(spark, R.token(F.lit(r))) for r in tokens} == tokens
    state = lambda r: one(spark, R.remembered_state(F.lit(r)))
    assert [state(r) for r in ("TYPE_FILE_MARK_DEDUPE", "TYPE_P_HASH_REJECT_NEWER", "TYPE_DEEP_LEARNING", "TYPE_FILE_MARK_BLOCK", "TYPE_HASH_MATCH", "TYPE_NG_FILE_NAME", "TYPE_P_HASH_REJECT_LOW_ENTROPY")] == [100, 100, 0, 0, None, None, None]
    assert one(spark, R.erased_state(F.lit("TYPE_LOW_LONG_SIDE"))) == -1 and "TYPE_HASH_MATCH" not in R.MARK_OF and len(R.MARK_OF) == 25 and len(R.SWEPT) == 13


def test_paths(spark):
    assert one(spark, P.dedupe_tokens(F.lit("/a/b/a/c/b/x.jpg"))) == "/a/b/c/x.jpg"
    assert one(spark, P.marks(F.lit("/a/x.!sr.jpg"))) == ["save", "replace"]
    assert one(spark, P.marks(F.lit("/!hold/x.!s.jpg"))) == ["hold"]
    assert one(spark, P.marks(F.lit("/a/x.!ut.jpg"))) == []
    assert one(spark, P.marks(F.lit("/a/x.!r12.jpg"))) == ["replace"] and one(spark, P.mark_number(F.lit("/a/x.!r12.jpg"))) == 12 and one(spark, P.mark_number(F.lit("/a/x1.jpg"))) is None
    marked = P.with_marks(F.lit("/a/x.jpg"), F.array(F.lit("s")), F.lit("010"))
    assert one(spark, marked) == "/a/[!_010]x.!s.jpg"
    assert one(spark, P.without_marks(marked)) == "/a/x.jpg"
    assert one(spark, P.ancestors(F.lit("/a/b/x.jpg"))) == ["/a", "/a/b"]
    assert one(spark, P.rename(F.lit("a1b1"), [("[0-9]", "_", False)])) == "a_b1"


def test_numbers(spark):
    assert [one(spark, N.half_up(F.lit(x), 3)) for x in (0.92985, 0.06747, 0.00188, 0.00078, 0.00002)] == [0.93, 0.067, 0.002, 0.001, 0.0]
    assert one(spark, N.aspect_ratio(F.lit(4), F.lit(0))) == 0
    assert one(spark, N.bits(F.lit(True), F.lit(False), F.lit(True))) == 5


def test_upsert_last_wins_and_keeps_others(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, t int")
    new = spark.createDataFrame([("a", 5, 2), ("a", 6, 3), ("c", 7, 1)], "k string, v int, t int")
    assert sorted((r.k, r.v) for r in G.upsert(old, new, "k", "t").collect()) == [("a", 6), ("b", 2), ("c", 7)]
    assert G.upsert(old.limit(0), new.limit(0), "k", "t").count() == 0
    assert [r.k for r in G.delete(old, spark.createDataFrame([("",), ("a",)], "k string"), "k").collect()] == ["b"]


SURE, KEPT = {"may_be": False}, {"keeping": True}
CASES = [
    # factors of one candidate, action and reason
    ({"small_pixel": True}, "delete", "TYPE_P_HASH_REJECT_LOW_RESOLUTION"),
    ({"small_size": True}, "delete", "TYPE_P_HASH_REJECT_LOW_FILE_SIZE"),
    ({"newer": True, "same_pixel": True}, "delete", "TYPE_P_HASH_REJECT_NEWER"),
    ({"newer": True}, "replace", "TYPE_P_HASH_MATCH"),
    ({"small_pixel": True, "may_be": True}, "hold", "TYPE_P_HASH_REJECT_LOW_RESOLUTION"),
    ({"small_pixel": True, "will_keep": True}, "save", "TYPE_P_HASH_MATCH_WILL_KEEP"),
    ({"small_pixel": True, "will_keep": True, "keeping": True}, "delete", "TYPE_P_HASH_REJECT_LOW_RESOLUTION"),
    ({"accessible": False}, "hold", "TYPE_P_HASH_MATCH_LOST_FILE"),
    ({"accessible": False, "small_size": True}, "delete", "TYPE_P_HASH_REJECT_LOW_FILE_SIZE"),
    ({"valid": False}, "hold", "TYPE_PROCESS_ERROR"),
    ({"in_mean": 200.0}, "hold", "TYPE_P_HASH_REJECT_DIFFERENT_MEAN"),
    ({"in_mean": 200.0, "may_be": True}, "hold", "TYPE_P_HASH_REJECT_DIFFERENT_MEAN"),
    ({"in_entropy": 99.9}, "delete", "TYPE_P_HASH_REJECT_LOW_ENTROPY"),
    ({"in_quality": 10.0}, "delete", "TYPE_P_HASH_REJECT_LOW_QUALITY"),
    ({"in_quality": 10.0, "cat_quality": None, "cat_mean": None}, "replace", "TYPE_P_HASH_MATCH"),
    ({"keeping": True}, "save", "TYPE_P_HASH_MATCH_KEEPING"),
    ({"keeping": True, "will_keep": True}, "save", "TYPE_P_HASH_MATCH_KEEPING"),
    ({"will_keep": True}, "transfer", "TYPE_P_HASH_MATCH_TRANSFER"),
    ({"will_keep": True, "may_be": True}, "hold", "TYPE_P_HASH_MATCH_TRANSFER"),
    ({"may_be": True}, "hold", "TYPE_P_HASH_MATCH"),
    ({}, "replace", "TYPE_P_HASH_MATCH"),
]


def test_candidate_rules(spark):
    base = {"small_pixel": False, "same_pixel": False, "small_size": False, "newer": False, "valid": True, "may_be": False, "keeping": False, "will_keep": False, "accessible": True}
    base |= {f"{s}_{c}": 100.0 for s in ("in", "cat") for c in ("mean", "entropy", "quality")}
    rows = [base | factors | {"i": i} for i, (factors, _, _) in enumerate(CASES)]
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean'}" for k, v in base.items())
    got = {r.i: (r.action, r.reason) for r in J.remapped(J.judged(spark.createDataFrame(rows, f"{kinds}, i int"))).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1:] for c in CASES]


def test_a_save_is_never_chosen(spark):
    rows = [(1, 10, "save", "A", 0), (1, 11, "transfer", "B", 1), (2, 12, "hold", "C", 0), (2, 15, "save", "F", 1), (3, 13, "replace", "D", 0), (3, 14, "delete", "E", 5)]
    got = {r.in_id: (r.action, r.hit_id, r.reason, r.n_candidates) for r in J.near_verdicts(spark.createDataFrame(rows, "in_id long, cat_id long, action string, reason string, p_distance int")).collect()}
    assert got == {1: ("transfer", 11, "B", 0), 2: ("hold", None, "TYPE_P_HASH_MAY_BE", 2), 3: ("delete", 14, "E", 0)}


STEPS = [
    # what is known of a row, the verdict
    ({"ng": True, "kind": "SCRAP", "exact_id": 5}, ("delete", None, "TYPE_NG_FILE_NAME", 0)),
    ({"kind": "UNKNOWN"}, ("hold", None, "TYPE_UNKNOWN_FILE_TYPE", 0)),
    ({"kind": "SCRAP"}, ("delete", None, "TYPE_SCRAP_FILE_TYPE", 0)),
    ({"kind": "CACHE"}, ("delete", None, "TYPE_SWEEP_OWN_FILE", 0)),
    ({"kind": "CACHE", "source": True}, ("hold", None, "TYPE_KEEP_OWN_FILE", 0)),
    ({"from_path": "/in/a.!hs.txt", "quality": "TYPE_DAMAGED"}, ("hold", None, "TYPE_FILE_MARK_HOLD", 0)),
    ({"from_path": "/in/a.!b.txt"}, ("delete", None, "TYPE_FILE_MARK_BLOCK", 0)),
    ({"from_path": "/in/a.!b.txt", "exact_id": 5, "exact_state": 200}, ("hold", None, "TYPE_FILE_MARK_HOLD", 0)),
    ({"from_path": "/lib/a.!b.txt", "exact_id": 5, "exact_state": 200}, ("delete", None, "TYPE_FILE_MARK_BLOCK", 0)),
    ({"from_path": "/in/a.!b.txt", "exact_id": 5, "exact_state": 100}, ("delete", None, "TYPE_FILE_MARK_BLOCK", 0)),
    ({"from_path": "/in/a.!de.txt"}, ("delete", None, "TYPE_FILE_MARK_DEDUPE", 0)),
    ({"from_path": "/in/a.!e.txt"}, ("delete", None, "TYPE_FILE_MARK_ERASE", 0)),
    ({"from_path": "/in/a.!r2.txt", "first_id": 7, "numbered_id": 8}, ("replace", 8, "TYPE_FILE_MARK_REPLACE", 0)),
    ({"from_path": "/in/a.!r.txt", "first_id": 7, "named": 9}, ("replace", 7, "TYPE_FILE_MARK_REPLACE", 0)),
    ({"from_path": "/in/a.!r.txt", "named": 9}, ("replace", 9, "TYPE_FILE_MARK_REPLACE", 0)),
    ({"from_path": "/in/a.!r.txt"}, ("save", None, "TYPE_FILE_MARK_SAVE", 0)),
    ({"from_path": "/in/a.!t.txt", "first_id": 7}, ("transfer", 7, "TYPE_FILE_MARK_TRANSFER", 0)),
    ({"from_path": "/in/a.!t.txt", "named": 9}, ("save", None, "TYPE_FILE_MARK_SAVE", 0)),
    ({"from_path": "/!save/a.txt"}, ("save", None, "TYPE_FILE_MARK_SAVE", 0)),
    ({"quality": "TYPE_DAMAGED", "exact_id": 5}, ("hold", None, "TYPE_DAMAGED", 0)),
    ({"exact_id": 5, "exact_state": 200}, ("delete", None, "TYPE_HASH_MATCH", 0)),
    ({"exact_id": 5, "exact_state": 200, "state": 300}, ("transfer", 5, "TYPE_HASH_MATCH_TRANSFER", 0)),
    ({"exact_id": 5, "exact_state": 300, "state": 300}, ("delete", None, "TYPE_HASH_MATCH", 0)),
    ({"exact_id": 5, "exact_state": 300, "present": False}, ("save", 5, "TYPE_HASH_MATCH_RECOVERY", 0)),
    ({"exact_id": 5, "exact_state": 300, "present": False, "needless": True}, ("delete", None, "TYPE_HASH_MATCH", 0)),
    ({"exact_id": 5, "exact_state": 100, "present": False}, ("delete", None, "TYPE_HASH_MATCH", 0)),
    ({"failed": True, "rejected": True}, ("hold", None, "TYPE_DEEP_LEARNING", 0)),
    ({"rejected": True, "na": "delete"}, ("hold", None, "TYPE_DEEP_LEARNING", 0)),
    ({"na": "hold", "nr": "TYPE_P_HASH_MAY_BE", "nn": 3, "n_named": 2}, ("hold", None, "TYPE_P_HASH_MAY_BE", 3)),
    ({"n_named": 2}, ("hold", None, "TYPE_FILE_NAME_MATCH", 2)),
    ({}, ("save", None, "TYPE_NO_PROBLEM", 0)),
]
KNOWN = "ng boolean, kind string, source boolean, from_path string, quality string, exact_id long, exact_state long, present boolean, needless boolean, state long, first_id long, numbered_id long, named long, n_named long, rejected boolean, failed boolean, na string, nh long, nr string, nn int, i int"


def known(spark, cases):
    base = dict.fromkeys([f.split()[0] for f in KNOWN.split(", ")]) | {"ng": False, "kind": "TEXT", "source": False, "from_path": "/in/a.txt", "present": True, "needless": False, "state": 200, "rejected": False, "failed": False}
    return spark.createDataFrame([base | c | {"i": i} for i, c in enumerate(cases)], KNOWN)


def test_steps_of_the_cascade(spark):
    args = [F.col(c) for c in ("ng", "quality", "source", "rejected", "failed")]
    rows = known(spark, [c for c, _ in STEPS])
    got = {r.i: tuple(r.v) for r in rows.select("i", J.steps(*args).alias("v")).collect()}
    assert [got[i] for i in range(len(STEPS))] == [v for _, v in STEPS]
    other = rows.filter("quality is not null or rejected or state = 300").select("i", J.steps(*args, instant_delete=True, gate_deletes=True, recovery=False, no_transfer=True).alias("v")).collect()
    assert {(r.v.action, r.v.reason) for r in other} == {("hold", "TYPE_FILE_MARK_HOLD"), ("delete", "TYPE_DAMAGED"), ("delete", "TYPE_HASH_MATCH"), ("hold", "TYPE_DEEP_LEARNING"), ("delete", "TYPE_DEEP_LEARNING")}


def test_copies_within_a_batch(spark):
    rows = [(1, "a", 200, None, 3, "save", "TYPE_NO_PROBLEM"), (2, "a", 200, None, 1, "hold", "TYPE_FILE_NAME_MATCH"), (3, "a", 200, None, 4, "save", "TYPE_NO_PROBLEM"), (4, "a", 300, None, 5, "save", "TYPE_NO_PROBLEM"), (5, "a", 200, None, 6, "hold", "TYPE_FILE_MARK_HOLD"),
            (6, "b", 200, 90, 1, "save", "TYPE_NO_PROBLEM"), (7, "b", 200, 90, 2, "save", "TYPE_NO_PROBLEM"), (8, "c", 200, None, 1, "delete", "TYPE_P_HASH_REJECT_NEWER"), (9, "c", 200, None, 2, "save", "TYPE_NO_PROBLEM")]
    table = spark.createDataFrame([(*r[:5], "/x", *r[5:]) for r in rows], "in_id long, hash string, state long, exact_id long, timestamp long, from_path string, a string, r string")
    v = F.struct(F.col("a").alias("action"), F.lit(None).cast("long").alias("hit_id"), F.col("r").alias("reason"), F.lit(0).alias("n_candidates"))
    got = {r.in_id: (r.action, r.hit_id) for r in J.cascade(table, v).collect()}
    assert got == {1: ("save", None), 2: ("hold", None), 3: ("delete", None), 4: ("transfer", 1), 5: ("hold", None), 6: ("save", None), 7: ("save", None), 8: ("delete", None), 9: ("delete", None)}
    moved = J.cascade(table, v, relocate=True).filter("action = 'relocate'").collect()
    assert {(r.in_id, r.hit_id) for r in moved} == {(6, 90), (7, 90)}


def test_rows_of_a_batch_follow_earlier_ones(spark):
    rows = spark.createDataFrame([(5, "a", 1, "x"), (2, "a", 2, "x"), (3, "b", 3, "x"), (4, "c", 4, "x"), (1, "d", 5, "x")], "doc_id long, hash string, timestamp long, from_path string")
    pairs = spark.createDataFrame([(5, 3, 2), (3, 4, 1), (1, 5, 4), (4, 1, 3)], "a long, b long, distance int")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siftlake-"))
    got = {r.doc_id: r.first_id for r in J.within_batch(rows, pairs).collect()}
    # 4 is near 3 only, which was dropped; 1 is near 5 and nearer to 4, which stays
    assert got == {5: 5, 2: 5, 3: 5, 4: 4, 1: 4}


def test_search_ways_agree(spark):
    import random

    rng = random.Random(4)
    stored = [(i, rng.getrandbits(63), rng.getrandbits(63), 2.0 + rng.random(), 200, "/x") for i in range(40)]
    asked = [(100 + i, stored[i][1] ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(14))), stored[i][2], stored[i][3] + rng.uniform(-0.25, 0.25), 200, "/y") for i in range(40)]
    schema = "doc_id long, p_hash long, d_hash long, ratio double, state long, from_path string"
    a, b = spark.createDataFrame(asked, schema), spark.createDataFrame(stored, schema)
    ways = [M.near_dup_banded(a, b), M.near_dup_multi_index(a, b), M.near_dup_multi_index(a, b, slots=False)]
    expect = {(x[0], y[0]) for x in asked for y in stored if abs(x[3] - y[3]) <= 0.2 and (x[1] ^ y[1]).bit_count() < 11}
    for way in ways:
        found = [(r.in_id, r.cat_id) for r in way.collect()]
        assert set(found) == expect and len(found) == len(expect)
    near = [(r.in_id, r.cat_id) for r in M.near_dup_sure(a, b).collect()]
    assert set(near) == {(x, y) for x, y in expect if ({r[0]: r[1] for r in asked}[x] ^ stored[y][1]).bit_count() < 3} and len(near) == len(set(near))
    assert {(r.in_id, r.cat_id): r.d_distance for r in M.second_distance(ways[0], a.union(b).select("doc_id", "d_hash")).collect()} == {p: ({r[0]: r[2] for r in asked}[p[0]] ^ stored[p[1]][2]).bit_count() for p in expect}
