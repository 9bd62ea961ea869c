"""Phrase mining against a brute-force count, its SQL, and by hand."""

import glob
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from siftlake.llm import queries
from siftlake.llm.phrases import LOWER, UPPER, collocations, ngram_counts, weakest_cuts

SCHEMA = "doc_id long, text string, lang string"
FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest, least, cover, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(str.maketrans(UPPER, LOWER))):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, longest + 1):
                    if i + m <= len(w):
                        f[lang, tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in found.items():
        inside = lambda v: len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))  # noqa: E731, B023
        if any(g == lang and inside(v) and 100 * b >= cover * a for (g, v), b in found.items()):
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return [(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, ps in out.items() for i, (s, a, p, l, r) in enumerate(sorted(ps)[:top], 1)]


def rows_of(seed, docs=60):
    rng = random.Random(seed)
    words = ["a", "B", "b", "cé", "É", "é", "日本", "d-e", "x" * 30, " "]
    gaps = [" ", "  ", "\t", " \t", ". ", ",", "\n", "!", "\x0b", ";  "]
    texts = ["".join(rng.choice(words) + rng.choices(gaps, [30, 3, 3, 1, 2, 2, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 60))) for _ in range(docs)]
    return [(i, t, rng.choice(["en", "de", None, "und"])) for i, t in enumerate(texts)] + [(None, None, None), (1, "", "en"), (2, " \t. ", "fr")] + [(9, texts[0], "en")] * 5


@pytest.mark.parametrize(("seed", "longest", "cover", "top"), [(1, 3, 50, 2000), (2, 3, 90, 7), (3, 2, 50, 2000), (4, 5, 30, 2000)])
def test_rows_equal_a_brute_force_count(spark, seed, longest, cover, top):
    rows = rows_of(seed)
    got = collocations(spark.createDataFrame(rows, SCHEMA), longest, 5, cover, top).select(*FIELDS).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, longest, 5, cover, top))
    assert len(got) > 5


def test_rows_equal_the_sql(spark):
    sf, c = "/root/testdata/sf0.01", duckdb.connect()
    for path in glob.glob(f"{sf}/documents.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = c.sql(queries.ORACLES["op11_phrases"]).fetchall()
    got = queries.QUERIES["op11_phrases"](spark, sf)
    assert got.columns == FIELDS
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) > 300


def test_windows_end_with_their_piece_and_overlap(spark):
    rows = [(1, "a a a a. a a", "en")]
    got = {r.phrase: r.f for r in ngram_counts(spark.createDataFrame(rows, SCHEMA), 3, 1).collect()}
    assert got == {"": 6, "a": 6, "a a": 4, "a a a": 2}


def test_products_beyond_64_bits(spark):
    a, l, r = 10**13 + 7, 3 * 10**13 + 1, 2 * 10**13 + 9
    grams = spark.createDataFrame([("en", "x", 1, l), ("en", "y", 1, r)], "lang string, phrase string, words int, f long")
    got = weakest_cuts(spark.createDataFrame([("en", "x y", 2, a)], "lang string, phrase string, words int, a long"), grams).first()
    assert got.score == 1000000 * a * a // (l * r)


def test_empty_tables_and_other_columns(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("x y " * 20, "en", "w", 1, 2)]
    got = collocations(spark.createDataFrame(rows, "text string, lang string, window string, f int, w1 int"), least=10).collect()
    assert {r.phrase for r in got} == {"x y x", "y x y"}


def test_a_very_long_text(spark):
    got = collocations(spark.createDataFrame([(1, "left right " * 200_000, "en")], SCHEMA)).collect()
    assert {(r.phrase, r.a, r.n) for r in got} == {("left right left", 199_999, 400_000), ("right left right", 199_999, 400_000)}
