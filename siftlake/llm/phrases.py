"""Collocations by top-order marginalisation: only the longest windows are counted, shorter n-grams are their sums.

Texts are cut into pieces at punctuation and line ends, pieces into words. Every word leads one
window: itself and the words after it in its piece, ``longest`` at most; windows at a piece's end
are padded. The following words come from the piece's own array, as LEAD would give them, so
nothing is shuffled or sorted to find them. The windows are counted once, folded map-side. What
begins with a prefix is the sum of its windows, padded ones included, so a ROLLUP over the windows'
words gives the counts of all shorter n-grams, and of all words of a language, without exploding
the texts again; windows that are no candidates count as padded there. All n-grams that begin with
a word are counted together, so the words are dealt into ``slices`` by hash and counted slice by
slice: only a slice's shuffles lie on disk at a time.

A candidate is a phrase of two words or more with ``least`` occurrences. Both parts of each cut
occur at least as often as it does, so the table of n-grams that is kept holds frequent ones only.
Its score is that of its weakest cut, floor(1000000 a a / (l r)), in exact decimals: 38 digits
hold it for counts up to 10^15. Candidates that a longer candidate mostly explains are dropped.

Hot keys: words and phrases are folded before every shuffle; a language's ranks come from its
best rows of each of ``SALTS`` shares, so no task ranks all of a language's candidates.

Defined results: null and empty texts have no words; a null language is ``und``, together with
rows that say so; repeated rows count each; ties go to the phrase first in UTF-8 byte order; an
empty table gives no rows; columns other than text and lang are not looked at.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PIECE_END = r"[.,;:!?\x0A-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shares of a language that are ranked on their own first.
SALTS = 64


def windows(docs: DataFrame, longest: int, slices: int = 1, part: int = 0) -> DataFrame:
    """lang, window: for every word (of a slice) the words from it on, space-joined, ``longest`` at most."""
    pieces = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(F.coalesce("text", F.lit("")), PIECE_END)).alias("piece"))
    # of pieces in ASCII lower() changes A-Z only, and is many times faster
    small = F.when(F.octet_length("piece") == F.length("piece"), F.lower("piece")).otherwise(F.translate("piece", UPPER, LOWER))
    words = pieces.select("lang", F.array_remove(F.split(F.replace(small, F.lit("\t"), F.lit(" ")), " "), "").alias("w"))
    lead = [F.slice("w", k + 1, F.size("w")).alias(f"w{k}") for k in range(longest)]
    rows = words.select("lang", F.inline(F.arrays_zip(*lead)))
    rows = rows if slices == 1 else rows.filter(F.pmod(F.hash("w0"), F.lit(slices)) == part)
    return rows.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(longest)]).alias("window"))


def ngram_counts(docs: DataFrame, longest: int = 3, least: int = 10, slices: int = 1, part: int = 0) -> DataFrame:
    """lang, phrase, words, f of the n-grams (of a slice) of up to ``longest`` words with at least that many occurrences; a row of no words holds the language's word count."""
    # one column makes narrower rows than two
    key = windows(docs, longest, slices, part).select(F.concat_ws("\t", "window", "lang").alias("key"))
    top = key.groupBy("key").agg(F.count("*").alias("f"))
    f, w = F.col("f"), [f"w{k}" for k in range(1, longest + 1)]
    top = top.select("key", F.split(F.substring_index("key", "\t", 1), " ").alias("w"), "f")
    word = [F.coalesce(F.get("w", F.lit(k)), F.lit("")) for k in range(longest)]
    # a rare window counts for its prefixes only, as a padded one
    word[-1] = F.when(f >= least, word[-1]).otherwise(F.lit(""))
    lang = F.substr("key", F.instr("key", "\t") + 1)
    sums = top.select(lang.alias("lang"), *[x.alias(c) for x, c in zip(word, w)], "f").rollup("lang", *w).agg(F.sum("f").alias("f"))
    # words that the rollup has summed over are null, padded ones empty
    padded = F.lit(False)
    for c in w:
        padded = padded | F.coalesce(F.col(c) == "", F.lit(False))
    size = sum((F.col(c).isNotNull().cast("int") for c in w[1:]), F.col(w[0]).isNotNull().cast("int"))
    grams = sums.filter(F.col("lang").isNotNull() & ~padded).select("lang", F.concat_ws(" ", *w).alias("phrase"), size.alias("words"), "f")
    return grams.filter((F.col("words") == 0) | (f >= least))


def _joined(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def weakest_cuts(candidates: DataFrame, grams: DataFrame) -> DataFrame:
    """lang, phrase, a, k, l, r, score of each candidate's lowest-scoring cut, of several the one after fewest words."""
    w, n = F.split("phrase", " "), F.col("words")
    at = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(k.alias("k"), _joined(w, F.lit(1), k).alias("left"), _joined(w, k + 1, n - k).alias("right")))
    cuts = candidates.select("lang", "phrase", "a", F.inline(at))
    side = lambda part, count: grams.select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    whole = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    score = F.expr(f"CAST({whole('a')} * {whole('a')} * 1000000 AS DECIMAL(38, 0)) DIV CAST({whole('l')} * {whole('r')} AS DECIMAL(38, 0))")
    return cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.*")


def covered(candidates: DataFrame) -> DataFrame:
    """lang, phrase, most: the occurrences of the most frequent longer candidate that a phrase lies in."""
    w, n = F.split("phrase", " "), F.col("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: _joined(w, i, m))))
    return candidates.filter(n > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000, slices: int = 2) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words.

    cover: the percentage of a phrase's occurrences from which a longer candidate replaces it.
    """
    parts = [common.cut(ngram_counts(docs, longest, least, slices, s), "ngrams") for s in range(slices)]
    grams = functools.reduce(DataFrame.unionByName, parts)
    candidates = grams.filter(F.col("words") >= 2).withColumnRenamed("f", "a")
    scored = weakest_cuts(candidates, grams.filter("words > 0"))
    scored = scored.join(covered(candidates), ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = scored.withColumn("i", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("i") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = grams.filter("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
