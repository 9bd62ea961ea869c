import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import order_minhash

LETTERS = "abcdefghijklmnop"


def word(rng):
    return "".join(rng.choice(LETTERS) for _ in range(7))


def similarity(a, b):
    """Edit similarity of two word lists by the plain dynamic program."""
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j - 1] + (x != y), p[j] + 1, c[-1] + 1))
        p = c
    return 1 - p[-1] / max(len(a), len(b), 1)


def components(texts, least=0.8):
    """Classes by all pairs."""
    words, top = [t.lower().split() for t in texts], list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if min(len(words[i]), len(words[j])) >= least * max(len(words[i]), len(words[j])) - 1e-9 and similarity(words[i], words[j]) >= least - 1e-9:
            top[root(j)] = root(i)
    return [root(i) for i in range(len(texts))]


def test_words_bring_all_similar_pairs_together(spark):
    """Every pair of similarity 0.8 and over of different components comes, whatever the blocks; most others don't."""
    rng = random.Random(3)
    shared, common = [word(rng) for _ in range(40)], [word(rng) for _ in range(12)]
    texts = []
    for _ in range(60):
        own = [rng.choice(common) if rng.random() < 0.3 else word(rng) for _ in range(rng.randrange(6, 14))]
        texts.append(shared + own)
        texts.append(shared + [word(rng) if rng.random() < 0.6 else w for w in own])
    texts += [[rng.choice(common) for _ in range(rng.randrange(1, 9))] for _ in range(60)] + [[]]
    hashes = order_minhash._word_hashes()
    rows = [(bytearray(hashlib.md5(str(i).encode()).digest()), bytearray(hashes(" ".join(t)).astype(np.uint32).tobytes())) for i, t in enumerate(texts)]
    of = {bytes(node): i for i, (node, _) in enumerate(rows)}
    nodes = spark.createDataFrame(rows, "node binary, words binary")
    # one component of every seven nodes
    comp = [rows[i - i % 7][0] for i in range(len(rows))]
    members = spark.createDataFrame([(r[0], c, [1, i % 2 + 2]) for i, (r, c) in enumerate(zip(rows, comp))], "node binary, comp binary, keys array<int>")
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if comp[i] != comp[j] and texts[i] and texts[j] and similarity(texts[i], texts[j]) >= 0.8 - 1e-9}
    assert len(want) > 50
    for block in (4096, 16):
        got = order_minhash.met_by_words(members, nodes, 0.8, block).collect()
        pairs = {tuple(sorted((of[bytes(r.a)], of[bytes(r.b)]))) for r in got}
        assert len(got) < 1.5 * len(pairs) and want <= pairs and all(comp[i] != comp[j] for i, j in pairs)
        assert len(pairs) < len(texts) ** 2 / 6
    apart = members.withColumn("keys", F.slice("keys", 2, 1))
    got = {tuple(sorted((of[bytes(r.a)], of[bytes(r.b)]))) for r in order_minhash.met_by_words(apart, nodes, 0.8, 4096).collect()}
    assert {(i, j) for i, j in want if i % 2 == j % 2} <= got and all(i % 2 == j % 2 for i, j in got)


def test_large_buckets_are_compared_in_full(spark):
    """200 pairs share a passage: pairs meet in large mixed buckets only, and the changed words are in every own k-mer of five."""
    rng = random.Random(11)
    shared, rows = [word(rng) for _ in range(100)], []
    for g in range(200):
        own = [word(rng) for _ in range(60)]
        near = [word(rng) if i % 5 == 0 else w for i, w in enumerate(own)]
        rows += [(2 * g, " ".join(shared + own)), (2 * g + 1, " ".join(shared + near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (64, 4096):
        of = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs, block=block).collect()}
        assert all(of[2 * g] == of[2 * g + 1] for g in range(200)) and len(set(of.values())) == 200


def test_near_duplicates_at_the_border(spark):
    """Pairs of similarity 0.80 to 0.87 that share no or few k-mers of five, short and long."""
    rng = random.Random(12)
    rows, number = [], 0
    for n, pairs in ((50, 30), (120, 30), (1000, 10)):
        for step in (5, 6, 7, 0):
            for _ in range(pairs):
                own = [word(rng) for _ in range(n)]
                changed = set(rng.sample(range(n), n // 5)) if not step else set(range(step - 1, n, step))
                rows += [(number, " ".join(own)), (number + 1, " ".join(word(rng) if i in changed else w for i, w in enumerate(own)))]
                number += 2
    of = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = sum(of[a] != of[a + 1] for a in range(0, number, 2))
    assert lost <= 0.02 * number / 2 and len(set(of.values())) == number // 2 + lost


def test_classes_are_those_of_all_pairs(spark):
    """Families of near copies around one passage: every class holds what all-pairs components hold, and nothing else."""
    rng = random.Random(5)
    shared, texts = [word(rng) for _ in range(30)], []
    for _ in range(25):
        base = shared + [word(rng) for _ in range(rng.randrange(5, 40))]
        for _ in range(rng.randrange(1, 6)):
            texts.append(" ".join(word(rng) if rng.random() < 0.06 else w for w in base))
    texts += texts[:5] + ["", "  ", "a", "A"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in order_minhash.near_duplicates(docs).collect()}
    want = components(texts)
    first = {}
    for i, w in enumerate(want):
        first.setdefault(w, i)
    wrong = [i for i in got if got[i].class_id != first[want[i]]]
    assert not wrong
    assert all(got[i].class_size == want.count(want[i]) for i in got)


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows_and_clashing_columns(spark, n):
    docs = spark.createDataFrame([(1, "a b c", "x", 1, "k")][:n], "doc_id long, text string, node string, n int, key string")
    assert [(r.doc_id, r.class_id, r.class_size) for r in order_minhash.near_duplicates(docs).collect()] == [(1, 1, 1)][:n]


def test_keys_are_shared_in_slices_and_leave_the_disk_before_texts_are_aligned(spark, monkeypatch):
    """Disk holds one slice's shuffles, and no keys beside the words."""
    import os

    from siftlake.llm import common

    cut, cut_by, names, sketches = common.cut, common.cut_by, [], []

    def spied(df, name="step", parts=()):
        names.append(name)
        if name == "leaders":
            assert not os.path.exists(sketches[0]._scratch)
        return cut(df, name, parts)

    monkeypatch.setattr(common, "cut", spied)
    monkeypatch.setattr(common, "cut_by", lambda df, key, name="step": sketches.append(cut_by(df, key, name)) or sketches[-1])
    text = " ".join(f"w{i}" for i in range(60))
    got = order_minhash.near_duplicates(spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3}
    assert names.count("shared-keys") > 1
