"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary n-gram classifier per bit tells the languages
with a 1 there from those with a 0. A classifier is a table of log-odds over hashed byte
n-grams (3 and 4 bytes of the lower-cased text, everything but letters taken as one space);
a text's margin is the mean log-odds of its n-grams. Decoding is loss-weighted: each
codeword is charged the logistic loss of every margin against its bit, weighted by how well
that bit separates the languages it was trained on, and the cheapest codeword wins. The
score is the softmax of the two cheapest losses, and a text whose score is under
``AMBIGUOUS`` is flagged. On demand the fit comes along: the mean log-probability of the
n-grams in the language where it is largest, less that of n-grams by chance.

Training reads a sample of labelled documents drawn by a hash of the id, ``per_language``
expected for each language (all, if fewer). Languages are values of a label column; the
n-gram table held by each task has 2**BITS rows of one number a bit.

Defined results: a null text or one without any letter is ``und`` with score 0; a text with
letters gets a learned language, however short; null labels teach nothing; without any
labelled document everything is ``und``; repeated rows are predicted alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import segments

BITS = 16
AMBIGUOUS = 0.6
#: Bytes of letters stay; ASCII others become a space. Bytes over 127 belong to letters or are rare.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(text: str) -> np.ndarray:
    """Hashed 3- and 4-byte n-grams of a text."""
    b = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    b = b[~((b == 32) & (np.concatenate(([0], b[:-1])) == 32))].astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    four = three[:-1] | b[3:] << np.uint32(24)
    mixed = np.concatenate([three * np.uint32(2654435761) ^ np.uint32(0x5BD1E995), four * np.uint32(2246822519)])
    return (mixed ^ mixed >> np.uint32(15)) * np.uint32(2654435769) >> np.uint32(32 - BITS)


def codebook(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +-1: all distinct splits for up to 7 languages, else the best of some random dense codes."""
    if n <= 7:
        rows = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1)]
        return np.array([r for r in rows if -1 in r] or [(1,) * n]).T
    rng, width, best, far = np.random.default_rng(seed), int(10 * np.log2(n)), None, -1
    for _ in range(64):
        code = rng.choice([-1, 1], (n, width))
        gap = ((width - code @ code.T) / 2 + width * np.eye(n)).min()
        if gap > far and (abs(code.sum(0)) < n).all():
            best, far = code, gap
    return best if best is not None else code


def _count(batches):
    """(lang, gram, n) of a task's labelled texts."""
    seen: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            got = _grams(text)
            if len(got):
                seen[lang] = seen.get(lang, 0) + np.bincount(got, minlength=1 << BITS)
    for lang, counts in seen.items():
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "gram": at, "n": counts[at]})


def train(labelled: DataFrame, per_language: int = 20_000) -> dict:
    """Fit on labelled(doc_id, text, lang); comes back as arrays of languages x 2**BITS numbers."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / sizes[k]))]), F.col("lang"))
    counted = labelled.filter(draw < rate).select("lang", "text").mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = np.zeros((len(langs), 1 << BITS))
    for r in counted.toLocalIterator():
        table[langs.index(r["lang"]), r["gram"]] = r["n"]
    p = (table + 0.5) / (table + 0.5).sum(1, keepdims=True)
    code = codebook(len(langs))
    ones, zeros = code > 0, code < 0
    w = np.zeros((1 << BITS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        if ones[:, b].any() and zeros[:, b].any():
            w[:, b] = np.log(p[ones[:, b]].mean(0) / p[zeros[:, b]].mean(0))
    margins = p @ w  # of each language's average text
    high = np.where(ones, margins, np.inf).min(0)
    low = np.where(zeros, margins, -np.inf).max(0)
    gap = np.where(np.isfinite(high - low), np.maximum(high - low, 1e-3), 1e-3)
    middle = np.where(np.isfinite(high + low), (high + low) / 2, 0)
    return {"langs": langs, "w": w, "code": code, "middle": middle, "fit": (np.log(p).T + BITS * np.log(2)).astype(np.float32), "half": gap / 2, "weight": gap / gap.sum()}


def decode(model: dict, margins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword and its score, of mean margins over n n-grams."""
    sure = 4.0 * n / (n + 12.0)
    z = (margins - model["middle"]) / model["half"] * sure[:, None]
    loss = np.stack([np.logaddexp(0, -z * c) @ model["weight"] for c in model["code"]], 1) * model["code"].shape[1] ** 0.5
    best = loss.argmin(1)
    if loss.shape[1] == 1:
        return best, np.ones(len(best))
    two = np.partition(loss, 1, axis=1)
    return best, 1 / (1 + np.exp(two[:, 0] - two[:, 1]))


def _predictor(shared, names: list[str], fit: bool):
    def run(batches):
        model = shared.value
        for batch in batches:
            for first, last in segments.slices(batch.column("text")):
                part = batch.slice(first, last - first)
                margins, n, lettered, fits = [], [], [], []
                for text in part.column("text"):
                    text = text.as_py()
                    letters = bool(model["langs"]) and isinstance(text, str) and any(map(str.isalpha, text))
                    got = _grams(text) if letters else np.empty(0, np.int64)
                    lettered.append(letters)
                    n.append(len(got))
                    if letters:
                        margins.append(model["w"][got].mean(0) if len(got) else np.zeros(model["code"].shape[1]))
                    if fit:
                        fits.append(float(model["fit"][got].mean(0).max()) if len(got) else None)
                found, scores = np.full(len(n), "und", object), np.zeros(len(n))
                at = np.flatnonzero(lettered)
                if len(at):
                    best, scores[at] = decode(model, np.stack(margins).astype(float), np.array(n)[at])
                    found[at] = [model["langs"][k] for k in best]
                columns = {c: part.column(c) for c in names} | {"lang_pred": pa.array(found, pa.string()), "score": pa.array(scores), "ambiguous": pa.array((found != "und") & (scores < AMBIGUOUS), pa.bool_())}
                if fit:
                    columns["fit"] = pa.array(fits, pa.float64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def predict(docs: DataFrame, model: dict, keep: list[Column], fit: bool = False) -> DataFrame:
    """The kept columns of docs(text) (text itself only if it is one) with lang_pred, score and ambiguous, and fit (null without n-grams) where asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    rows = kept if "text" in kept.columns else docs.select(*keep, "text")
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType()), *([StructField("fit", DoubleType())] if fit else [])])
    return rows.mapInArrow(_predictor(shared, kept.columns, fit), schema)
