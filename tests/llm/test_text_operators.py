import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from siftlake.llm import langid, mixing, order_minhash, sharding, token_files

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long"


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j - 1] + (x != y), p[j] + 1, c[-1] + 1))
        p = c
    return p[-1]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated and very long texts, null ids and sources, a column whose name clashes."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    base = [word() for _ in range(200)]
    near = base[:]
    for i in range(0, 200, 14):
        near[i] = word()
    texts = [None, "", "  \n", "a", " ".join(base), " ".join(base), " ".join(near), " ".join(word() for _ in range(30_000)), " ".join(word() for _ in range(60)), "x  y \n z", None]
    rows = [(i if i != 8 else None, t, None if i == 3 else "en", None if i % 3 == 0 else f"s{i % 2}", 0, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4]], DOCS)


def test_alignment_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.randrange(6) for _ in range(rng.randrange(25))]
        b = [x for x in a if rng.random() > 0.15]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(6))
        most = rng.randrange(12)
        assert order_minhash.aligned_distance(a, b, most) == min(edit(a, b), most + 1)


def test_order_matters_to_the_sketch():
    w = np.arange(100, dtype=np.uint64)
    same = order_minhash.sketch(w, 40, 5)
    assert (same == order_minhash.sketch(w.copy(), 40, 5)).all()
    swapped = np.concatenate([w[50:], w[:50]])  # the same k-mers but for the seam
    assert 0.2 < (same == order_minhash.sketch(swapped, 40, 5)).mean() < 0.8


def test_near_duplicate_classes(spark, odd):
    got = order_minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    of = {r.doc_id: r.class_id for r in got}
    assert of[4] == of[5] == of[6] == 4 and of[1] == of[2] == 1 and of[0] == 0 and of[10] == 10 and of[3] == 3
    assert order_minhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text.lower().split()) for r in docs.collect()]
    of = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            longer = max(len(x), len(y))
            if (Counter(x) & Counter(y)).total() >= 0.8 * longer and order_minhash.aligned_distance(x, y, int(0.2 * longer + 1e-9)) <= 0.2 * longer:
                assert of[a] == of[b]


def test_mixing(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.cube_mix(docs).collect()
    assert len(got) == docs.count() and sorted(mixing.cube_mix(docs).collect()) == sorted(got)
    sums = {}
    for r in got:
        t = sums.setdefault(r.source, [r.target, 0, r.source_size, 0])
        t[1] += r.taken
        t[3] += r.size
        assert r.taken <= 3 * r.size
    assert all(s[2] == s[3] for s in sums.values()) and abs(sum(s[0] for s in sums.values()) - sum(s[3] for s in sums.values())) < 1e-6
    assert sum(abs(s[1] - s[0]) for s in sums.values()) < 0.2 * sum(s[0] for s in sums.values())
    assert mixing.cube_mix(odd).count() == odd.count() and mixing.cube_mix(odd.limit(0)).count() == 0


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(2)
    pi, size = rng.random(500), rng.integers(1, 900, 500).astype(float)
    out = mixing.fly(pi, size, rng)
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs(out @ size - pi @ size) < 1e-3 and ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2


def test_language_id(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter("doc_id % 3 <> 1"))
    held = docs.filter("doc_id % 3 = 1 and n_chars > 60")
    got = langid.predict(held, model, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    strange = langid.predict(odd, model, ["doc_id"]).collect()
    assert {r.lang_pred for r in strange if r.doc_id in (0, 1, 2)} == {"und"} and len(strange) == odd.count()
    assert langid.predict(odd, langid.train(odd.limit(0)), ["doc_id"]).filter("lang_pred <> 'und'").count() == 0


def test_token_files(spark, odd):
    import tempfile

    from tokenizers import Tokenizer

    docs, t, at = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), Tokenizer.from_file(BPE), 0
    docs = docs.union(spark.createDataFrame([(900, None), (901, ""), (902, " a  b\n\n c "), (903, "x<|endoftext|>y it's 5.5%")], "doc_id long, text string"))
    folder = tempfile.mkdtemp(prefix="siftlake-")
    got = {r.doc_id: r for r in token_files.read_token_files(token_files.write_token_files(docs, BPE, folder), BPE, folder).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    folder = tempfile.mkdtemp(prefix="siftlake-")
    assert token_files.read_token_files(token_files.write_token_files(odd, BPE, folder), BPE, folder).count() == odd.count()


def test_sharding(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard_by_bytes(docs).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == docs.count() and len(sizes) == 16 and sizes.max() < 1.25 * sizes.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    assert sharding.shard_by_bytes(odd).count() == odd.count() and sharding.shard_by_bytes(odd.limit(0)).count() == 0


def test_mixing_lands_small_sources_beside_a_large_one(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(50, 150)), "hot") for i in range(500)]
    rows += [(1000 + i, " ".join(["w"] * (1000 if i == 0 else rng.randrange(50, 150))), f"small{s}") for s in range(6) for i in range(150)]
    df = spark.createDataFrame([(i if s == "hot" else i + 1000 * int(s[5:]), t, s) for i, t, s in rows], "doc_id long, text string, source string")
    sums = {}
    for r in mixing.cube_mix(df, block=200).collect():
        t = sums.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
    assert all(abs(taken - target) <= 2 for target, taken in sums.values()), sums
