"""Spelling variants: words one edit apart, found by asymmetric q-chunks; each word's more frequent form and root.

Words are runs of letters, lower-cased (A-Z only), counted over all texts and folded map-side. Of a
near pair one word contributes two disjoint chunks, its halves; the other, of the same length or one
longer, contributes its positional grams of the halves' lengths. One edit touches one half only: the
other is a gram of the longer word, in its own place or one further. So the pairs that share a chunk
and a gram at a shift of at most one hold all near pairs, and checking each finds them exactly.
Grams elsewhere could meet no chunk within that shift and are left out.

A half that many words share would make all their pairs, so the same is done again with the rest:
of what lies beside the preserved half one half is preserved too. The key is both chunks, with the
length of the word and which chunks they are; three quarters of the characters are equal within a
key. A pair that shares several keys counts at the first.

``form`` follows the near word of largest count if that is at least ``times`` the word's; counts
grow along such a chain, so it ends. Roots come by doubling: a chain of n forms takes log2(n) rounds.

Defined results: null and empty texts have no words, null ids count as empty ones; repeated rows
count each; ties go to the word first in code-point order; very long texts and words are taken
whole; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """doc_id (as text), run: all runs of letters, lower-cased."""
    text = F.translate("text", UPPER, LOWER)
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))


def misspelt(doc_id: Column, run: Column, every: int) -> Column:
    """The run, one in ``every`` (by a hash of the document and the run) without one code point."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(words: DataFrame, shortest: int, least: int) -> DataFrame:
    """word, n of words(word) of at least that many code points and occurrences."""
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _cut(word: Column, start: Column, size: Column) -> Column:
    return F.substr(word, start + 1, size)


def _key(length: Column, which: int, half: Column, quarter: Column) -> Column:
    return F.concat_ws("\x00", length.cast("string"), F.lit(str(which)), half, quarter)


def _halves(size: Column) -> tuple[Column, Column]:
    """Lengths of the first and the second half."""
    first = F.floor(size / 2).cast("int")
    return first, size - first


def chunk_keys(word: Column) -> Column:
    """The four keys of a word that contributes chunks: a half, and a half of the other half."""
    n = F.length(word)
    a, b = _halves(n)
    aa, ab = _halves(a)
    ba, bb = _halves(b)
    first, second = _cut(word, F.lit(0), a), _cut(word, a, b)
    return F.array(
        _key(n, 0, first, _cut(word, a, ba)),
        _key(n, 1, first, _cut(word, a + ba, bb)),
        _key(n, 2, second, _cut(word, F.lit(0), aa)),
        _key(n, 3, second, _cut(word, aa, ab)),
    )


def gram_keys(word: Column) -> Column:
    """The keys of a word that contributes grams, for chunks of words as long and one shorter: what stands where a chunk would, or one further."""
    keys = []
    for longer in (0, 1):
        n = F.length(word) - longer
        a, b = _halves(n)
        aa, ab = _halves(a)
        ba, bb = _halves(b)
        first, second = _cut(word, F.lit(0), a), _cut(word, a + longer, b)
        # beside an equal first half the edit lies in the second one, and the other way round
        keys += [
            _key(n, 0, first, _cut(word, a, ba)),
            _key(n, 1, first, _cut(word, a + ba + longer, bb)),
            _key(n, 2, second, _cut(word, F.lit(0), aa)),
            _key(n, 3, second, _cut(word, aa + longer, ab)),
        ]
    return F.array(*keys)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, na, nb: every pair of words(word, n) that differ by one inserted, deleted or replaced code point, once."""
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("na"), F.explode(chunk_keys(F.col("word"))).alias("key"))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.explode(gram_keys(F.col("word"))).alias("key"))
    a, b = F.col("a"), F.col("b")
    met = chunks.join(grams, "key").filter((F.length(a) < F.length(b)) | (a < b))
    met = met.filter(F.levenshtein(a, b, 1) == 1)
    # the first of the pair's common keys, so that nothing has to be made distinct
    first = F.get(F.array_intersect(chunk_keys(a), gram_keys(b)), F.lit(0))
    return met.filter(F.col("key") == first).select("a", "b", "na", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): where a word's forms lead; words without a form are left out."""
    open_, done = forms.select("word", F.col("form").alias("at")), None
    while True:
        ahead = forms.select(F.col("word").alias("at"), F.col("form").alias("next"))
        step = common.cut(open_.join(ahead, "at", "left"), "spelling-roots")
        ended = step.filter(F.col("next").isNull()).select("word", F.col("at").alias("root"))
        done = ended if done is None else done.unionByName(ended)
        open_ = step.filter(F.col("next").isNotNull()).select("word", F.col("next").alias("at"))
        if open_.isEmpty():
            return done
        # twice as far the next time
        far = forms.join(ahead.withColumnRenamed("at", "form"), "form", "left")
        forms = common.cut(far.select("word", F.coalesce("next", "form").alias("form")), "spelling-forms")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n)."""
    pairs = common.cut(near_pairs(words), "near-words")
    side = lambda x, y: pairs.select(F.col(x).alias("word"), F.struct((-F.col(f"n{y}")).alias("minus"), F.col(y).alias("form")).alias("near"))
    near = side("a", "b").unionByName(side("b", "a")).groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    out = words.join(near, "word", "left")
    takes = -F.col("near.minus") >= times * F.col("n")
    out = out.select("word", F.when(takes, F.col("near.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("near.minus")).alias("form_n"))
    out = common.cut(out, "spelling-out")
    ends = roots(out.filter(F.col("form").isNotNull()).select("word", "form"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """The variants of the words of docs(doc_id, text), of which one run in ``every`` is misspelt on purpose."""
    words = runs(docs).select(misspelt(F.col("doc_id"), F.col("run"), every).alias("word"))
    return variants(common.cut(word_counts(words, shortest, least), "words"), times)
