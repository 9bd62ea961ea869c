import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from siftlake.llm import lattice_lm
from siftlake.llm.common import doc_crc

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, weights, byte):
    """The probability of every segmentation of a word, listed one by one."""
    if not word:
        return [1.0]
    found = [weights[word[:k]] * rest for k in range(1, len(word) + 1) if word[:k] in weights for rest in segmentations(word[k:], weights, byte)]
    if word[0] not in weights:
        found += [byte ** len(word[0].encode()) * rest for rest in segmentations(word[1:], weights, byte)]
    return found


def test_lattice_sums_all_segmentations():
    weights = {"a": 0.2, "b": 0.1, "ab": 0.15, "aba": 0.05, "bb": 0.02, "é": 0.01, "日本": 0.03}
    lattice = lattice_lm.Lattice({p: math.log(w) for p, w in weights.items()}, math.log(0.2), math.log(0.001))
    rng = random.Random(2)
    words = ["a", "abab", "日本a", "x", "\U0001f600b", *("".join(rng.choice("abé日本z") for _ in range(rng.randrange(1, 10))) for _ in range(300))]
    got = lattice.scores(pa.array([w.encode() for w in words]), area=64)
    for word, score in zip(words, got, strict=True):
        assert score == pytest.approx(math.log(sum(segmentations(word, weights, 0.001)) * 0.2)), word
    assert lattice.scores(pa.array([], pa.binary())).tolist() == []
    assert np.isfinite(lattice.scores(pa.array([b"ab" * 20_000]))).all()
    assert lattice_lm.Lattice({}).scores(pa.array([b"xy"]))[0] == pytest.approx(2 * math.log(0.02 / 256) + math.log(0.2))


def test_vocabulary_weights_are_a_distribution():
    weights = lattice_lm.load_pieces(MODEL)
    assert sum(map(math.exp, weights.values())) == pytest.approx(0.78) and all(p == p.lower() for p in weights if p.isascii())


def test_words_of_texts():
    texts = pa.array(["The  the\x0bCAT", None, "", " x\ty ", "É\xa0é"])
    row, index, words = lattice_lm.words_of(texts)
    assert [(r, words[i].as_py().decode()) for r, i in zip(row, index)] == [(0, "the"), (0, "the"), (0, "cat"), (3, "x"), (3, "y"), (4, "É\xa0é")]


def brute(docs, held_out, label):
    """base and score of each document by the docstring's formulas, word by word."""
    words = {i: [*((t or "").encode().lower().split()), b""] for i, t, _ in docs}
    train = [(i, k) for i, _, k in docs if not held_out(i)]
    counts = {}
    for i, k in train:
        counts.setdefault(k if label else None, Counter()).update(words[i])
    all_ = sum(counts.values(), Counter())
    total, distinct = sum(all_.values()), len(all_)
    lattice = lattice_lm.Lattice(lattice_lm.load_pieces(MODEL))
    pieces = {w: math.exp(lattice.scores(pa.array([w]))[0]) for w in {w for t in words.values() for w in t} if w}
    base = lambda w: math.log10((all_[w] + 0.1) / (total + 0.1 * (distinct + 1)))

    def component(c, w):
        n, v = sum(c.values()), len(c)
        one, two = (sum(x == m for x in c.values()) for m in (1, 2))
        d = min(max(one / (one + 2 * two), 0.01), 0.99) if one else 0.5
        spare = max(d * v / n, 1e-6)
        return max(c[w] - d, 0) / n + (spare * (0.05 * all_[w] / total + 0.95 * pieces[w]) if w else 0)

    out = {}
    for i, t in words.items():
        own = [math.log10(c[b""] / all_[b""]) + sum(math.log10(component(c, w)) for w in t) for c in counts.values()]
        top = max(own)
        out[i] = sum(map(base, t)), top + math.log10(sum(10 ** (x - top) for x in own)), len(t), sum(all_[w] > 0 for w in t), total
    return out


@pytest.mark.parametrize(("label", "hot"), [(None, 0), ("lang", 30), ("lang", 100_000)])
def test_document_scores_against_brute_force(spark, label, hot):
    rows = [(r.doc_id, (r.text or "")[:3000], r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()[:80]]
    rows += [(1001, None, "en"), (1002, "", None), (1003, "Zq9 zq9 \U0001f600", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = brute(rows, lambda i: zlib.crc32(str(i).encode()) % 10 == 0, label)
    got = lattice_lm.score_documents(docs, doc_crc() % 10 == 0, MODEL, label=label, hot=hot).collect()
    assert len(got) == len(rows)
    for r in got:
        base, score, n, known, total = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_odd_rows(spark):
    schema = "doc_id long, text string, row long, word string, n long, lang string"
    odd = [(None, "a b", 1, "x", 2, "en"), (1, None, 1, "x", 2, None), (1, "b" * 50_000 + " c", 1, "x", 2, "en"), (2, "c c", 1, "y", 3, "en"), (2, "c c", 1, "y", 3, "en")]
    got = lattice_lm.score_documents(spark.createDataFrame(odd, schema), doc_crc() % 10 == 0, MODEL, label="lang").collect()
    assert len(got) == 5 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lattice_lm.score_documents(spark.createDataFrame([], schema), doc_crc() % 10 == 0, MODEL, label="lang").count() == 0
    # nothing to learn from
    none = lattice_lm.score_documents(spark.createDataFrame(odd, schema), doc_crc() >= 0, MODEL).collect()
    assert len(none) == 5 and all(math.isfinite(r.score) for r in none)  # a null id has no checksum, so it is a training row
    assert {r.n_known for r in lattice_lm.score_documents(spark.createDataFrame(odd[1:], schema), doc_crc() >= 0, MODEL).collect()} == {0}
