"""Spelling variants against brute force, and by hand."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from siftlake.llm import queries
from siftlake.llm.spelling import LOWER, UPPER, near_pairs, spelling_variants, variants

FIELDS = ["word", "form", "root", "n", "n_near", "form_n"]
WORDS = "word string, n long"


def counted(rows, every):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            out[run[:k] + run[k + 1 :] if h % every == 0 else run] += 1
    return out


def without_one(w):
    return {w[:i] + "\x00" + w[i + 1 :] for i in range(len(w))}


def neighbours(words):
    """Near words by what is left when a code point is taken out: replaced ones share a place, inserted ones the rest."""
    near, masked = defaultdict(set), defaultdict(set)
    for w in words:
        for m in without_one(w):
            masked[m].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for m in without_one(w):
            s = m.replace("\x00", "")
            if s in words:
                near[w].add(s)
                near[s].add(w)
    return near


def brute(counts, shortest, least, times):
    n = {w: c for w, c in counts.items() if len(w) >= shortest and c >= least}
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_the_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_spelling_variants"](spark, sf)
    assert got.columns == FIELDS
    got = [tuple(r) for r in got.collect()]
    want = brute(counted(rows, 199), 6, 5, 5)
    assert len(got) == len(want) and set(got) == want
    assert sum(w[1] is not None for w in want) > 20


@pytest.mark.parametrize(("seed", "letters"), [(1, "ab"), (2, "aéÿ"), (3, "abcde")])
def test_random_words_equal_brute_force(spark, seed, letters):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randint(6, 13))): rng.randint(5, 200) for _ in range(600)}
    got = variants(spark.createDataFrame(list(words.items()), WORDS)).collect()
    want = brute(Counter(words), 6, 5, 5)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_every_edit_of_a_word_is_found_once(spark):
    for word in ("abcdef", "abcdefg", "aaaaaaaa", "mississippi", "ÀÉîõüÿ"):
        edits = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "azÿ"} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "azÿ" + word}
        edits |= {word[:i] + word[i + 1 :] for i in range(len(word))}
        rows = [(w, 5) for w in {*edits, word, word + "zz", "zz" + word}]
        pairs = near_pairs(spark.createDataFrame(rows, WORDS)).collect()
        with_word = [r.b if r.a == word else r.a for r in pairs if word in (r.a, r.b)]
        assert sorted(with_word) == sorted(edits - {word})


def test_chains_lead_to_their_root(spark):
    words = [("a" * k + "b" * (40 - k), 5**k) for k in range(1, 12)]
    got = {r.word: r for r in variants(spark.createDataFrame(words, WORDS)).collect()}
    end = words[-1][0]
    assert {r.root for r in got.values()} == {end}
    assert all(got[w].form == v for (w, _), (v, _) in zip(words, words[1:])) and got[end].form is None and got[end].form_n is None


def test_ties_take_the_first_in_code_point_order(spark):
    words = [("abcdefg", 10), ("abcdef", 50), ("abcdefh", 50), ("Àbcdefg", 50), ("abcdeéfg", 50)]
    got = {r.word: tuple(r)[1:] for r in variants(spark.createDataFrame(words, WORDS)).collect()}
    assert got["abcdefg"] == ("abcdef", "abcdef", 10, 4, 50)
    assert got["Àbcdefg"] == (None, "Àbcdefg", 50, 1, None)


def test_nulls_repeated_rows_long_texts_and_other_columns(spark):
    schema = "doc_id long, text string, word string, n int"
    rows = [(None, "Straße strasse", "x", 1)] * 5 + [(1, None, None, 2), (2, "", None, 3), (3, "ÀÉÎ÷õ× " * 50_000, "y", 4), (4, "q" * 3_000, "z", 5)] + [(5, "q" * 3_000, "z", 5)] * 4
    got = [tuple(r) for r in spelling_variants(spark.createDataFrame(rows, schema), every=10**9).collect()]
    assert set(got) == brute(counted([r[:2] for r in rows], 10**9), 6, 5, 5)
    assert {"straße", "strasse", "ÀÉÎ÷õ×", "q" * 3_000} == {r[0] for r in got}
    assert spelling_variants(spark.createDataFrame([], schema)).count() == 0
