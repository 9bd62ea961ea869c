"""Document scores from a subword lattice.

A document is a sequence of words and one end. A word's lattice holds an arc for every piece
of an existing unigram vocabulary that its letters spell, weighted by the vocabulary's own
score, and a closing arc for the word's end; a character that is no piece is an arc weighted
as so many byte pieces. Words of the training documents have one arc more, across the whole
word. The log-space forward recursion sums the weights of all segmentations, so that the
probability of a word, and with them of the document, is the marginal one.

Weights (fixed: nothing of the vocabulary is fitted): of the mass at a word's position the
whole-word arcs hold what absolute discounting leaves them, (c - d) / N with d from the counts
of counts, and the subword arcs the rest. There the end holds ``END_MASS``, byte pieces
``BYTE_MASS`` and pieces the remainder, in proportion to exp(score), or to 1 / (rank + 10) where
the file holds ranks for scores, as those of merge tokenizers do.

Whole-word arcs are counted by component: each frequent label value of the training documents
is one, the rest another. A word known elsewhere has ``ELSEWHERE`` of a component's remaining
mass as its arc there. The document's probability is the marginal over the components too;
labels of scored documents are not looked at.

Words are lower-cased in A-Z and are runs of bytes other than ASCII white space. Each distinct
word runs through the recursion once, where its counts meet. Frequent words (``hot`` at most,
a bounded table) are then scored where the text is read; the others go through one shuffle as
(document, word, count).

Defined results: null text is an empty text (one token, the end); repeated rows and equal
or null ids are rows of their own; an empty table gives no rows; without training documents
word and base scores rest on smoothing alone; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, segments

LN10 = math.log(10)
END = b""  # no word is empty
END_MASS, BYTE_MASS, ELSEWHERE = 0.2, 0.02, 0.05
#: Rows of partial counts that a task gathers before it sends them on.
_FLUSH = 300_000
_SPACE, _LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_SPACE[[32, *range(9, 14)]] = True
_LOWER[65:91] += 32


def load_pieces(model_path: str) -> dict[str, float]:
    """Log weights of the pieces of a vocabulary file that lower-cased words can hold.

    A word's first piece and the same letters later are one arc here; its weight is their sum.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found: dict[str, float] = {}
    scores = [model.get_score(i) for i in range(model.get_piece_size())]
    ranks = min(scores, default=0.0) < -1000  # no log-probability of a piece is so low
    upper = {c: c + 32 for c in range(65, 91)}
    for i, score in enumerate(scores):
        piece = model.id_to_piece(i)
        bare = piece[1:] if piece.startswith("▁") else piece
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or not bare or "▁" in bare or bare != bare.translate(upper):
            continue
        found[bare] = found.get(bare, 0.0) + (1 / (10 - score) if ranks else math.exp(score))
    total = sum(found.values()) / (1 - END_MASS - BYTE_MASS)
    return {p: math.log(w / total) for p, w in found.items()}


class Lattice:
    """Subword arcs over words, for many words at once."""

    _BASE, _SPREAD, _MARKS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), 20

    def __init__(self, weights: dict[str, float], end: float = math.log(END_MASS), byte: float = math.log(BYTE_MASS / 256)):
        self.end, self.byte = end, byte
        self.longest = max(map(len, weights), default=1)
        self.powers = np.cumprod(np.full(self.longest + 1, self._BASE)) * np.uint64(pow(int(self._BASE), -1, 1 << 64))
        self.marks = np.zeros(1 << self._MARKS, bool)
        words = list(weights)
        code = np.zeros((len(words), self.longest), np.uint64)
        for row, w in zip(code, words):
            row[: len(w)] = [ord(c) for c in w]
        prefix = self._prefixes(code)
        keys = self._slot(prefix[np.arange(len(words)), [len(w) for w in words]]) if words else np.empty(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([weights[w] for w in words])[order]
        self.marks[(keys >> np.uint64(64 - self._MARKS)).astype(np.int64)] = True

    def _prefixes(self, code: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes of the rows."""
        out = np.zeros((len(code), code.shape[1] + 1), np.uint64)
        for j in range(code.shape[1]):
            out[:, j + 1] = out[:, j] * self._BASE + code[:, j] + np.uint64(1)
        return out

    def _slot(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * self._SPREAD
        return h ^ (h >> np.uint64(29))

    def _weights(self, h: np.ndarray) -> np.ndarray:
        """Log weights of the pieces with these hashes; -inf where there is none."""
        keys, out = self._slot(h), np.full(h.shape, -np.inf)
        at = np.nonzero(self.marks[(keys >> np.uint64(64 - self._MARKS)).astype(np.int64)])
        if len(at[0]):
            k = keys[at]
            place = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out[at] = np.where(self.keys[place] == k, self.values[place], -np.inf)
        return out

    def _forward(self, code: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward recursion over rows of code points, all rows a position at a time."""
        n, width = code.shape
        prefix, ahead = self._prefixes(code), np.full((n, width + 1), -np.inf)
        ahead[:, 0] = 0
        size = 1 + (code > 0x7F) + (code > 0x7FF).astype(int) + (code > 0xFFFF)
        for j in range(1, width + 1):
            starts = np.arange(max(0, j - self.longest), j)
            arcs = self._weights(prefix[:, j, None] - prefix[:, starts] * self.powers[j - starts][None])
            bare = arcs[:, -1] == -np.inf
            arcs[bare, -1] = self.byte * size[bare, j - 1]
            arcs += ahead[:, starts]
            top = arcs.max(1)
            ahead[:, j] = top + np.log(np.exp(arcs - top[:, None]).sum(1))
        return ahead[np.arange(n), lengths] + self.end

    def scores(self, words: pa.Array, area: int = 1 << 17) -> np.ndarray:
        """Log of the marginal probability of each word."""
        n = len(words)
        text = b"\n".join(words.to_pylist()).decode("utf-8", "replace") + "\n" if n else ""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        ends = np.flatnonzero(points == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if n else ends
        lengths, out, at = ends - starts, np.empty(n), 0
        order = np.argsort(lengths, kind="stable")
        while at < n:
            # rows of like length, about ``area`` characters of them
            size = lengths[order[at:]] * np.arange(1, n - at + 1)
            rows = order[at : at + max(1, int(np.searchsorted(size, area, "right")))]
            width = int(lengths[rows].max(initial=0))
            inside = np.arange(width)[None] < lengths[rows][:, None]
            code = np.where(inside, points[np.minimum(starts[rows][:, None] + np.arange(width)[None], len(points) - 1)], 0).astype(np.uint64)
            out[rows] = self._forward(code, lengths[rows])
            at += len(rows)
        return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All words of a column in order: the row and the number of each, and the distinct words."""
    run, at = segments.flat(texts)
    visible = ~_SPACE[run]
    edge = np.zeros(len(run) + 1, bool)
    edge[at] = True
    before, after = np.concatenate([[False], visible[:-1]]), np.concatenate([visible[1:], [False]])
    starts = np.flatnonzero(visible & (~before | edge[:-1]))
    ends = np.flatnonzero(visible & (~after | edge[1:])) + 1
    found = segments.segments(_LOWER[run], starts, ends).dictionary_encode()
    return np.searchsorted(at, starts, "right") - 1, found.indices.to_numpy().astype(np.int64), found.dictionary


def _count_words(components: int):
    """(word, n0, n1, ...) of a task's texts: occurrences by component, the end included; held-out texts count for nothing, but their words come too."""
    names = [f"n{k}" for k in range(components)]

    def run(batches):
        waiting, rows = [], 0

        def flush():
            merged = pa.concat_tables(waiting).group_by("word").aggregate([(c, "sum") for c in names])
            for batch in merged.rename_columns(["word", *names]).to_batches(max_chunksize=50_000):
                yield batch

        for batch in batches:
            k_of_row = batch.column("k").to_numpy(zero_copy_only=False)
            waiting.append(pa.table({"word": pa.array([END], pa.binary()), **{c: pa.array([int((k_of_row == k).sum())], pa.int64()) for k, c in enumerate(names)}}))
            texts = batch.column("text")
            for first, last in segments.slices(texts):
                row, index, words = words_of(texts.slice(first, last - first))
                k = k_of_row[first:last][row]
                waiting.append(pa.table({"word": words, **{c: np.bincount(index[k == i], minlength=len(words)) for i, c in enumerate(names)}}))
                rows += len(words)
                if rows > _FLUSH:
                    yield from flush()
                    waiting, rows = [], 0
        if waiting:
            yield from flush()

    return run


def _with_scores(model_path: str):
    """Adds the lattice's log probability to words."""

    def run(batches):
        lattice = Lattice(load_pieces(model_path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lattice.scores(batch.column("word")))], [*batch.schema.names, "piece_logp"])

    return run


def _first_pass(shared):
    """Per document the sums over frequent words, and its other words with their counts."""

    def run(batches):
        known, numbers = shared.value  # words; their rows of numbers
        words_known = pa.array(known, pa.binary())
        for batch in batches:
            texts = batch.column("text")
            for first, last in segments.slices(texts):
                row, index, words = words_of(texts.slice(first, last - first))
                n = last - first
                at = pc.index_in(words, value_set=words_known).fill_null(-1).to_numpy(zero_copy_only=False)[index]
                common_, rare = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                sums = np.stack([np.bincount(row[common_], numbers[at[common_], c], minlength=n) for c in range(numbers.shape[1])], 1) if n else np.empty((0, numbers.shape[1]))
                pairs, times = np.unique(row[rare] * max(1, len(words)) + index[rare], return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(n + 1) * max(1, len(words))).astype(np.int32))
                kept = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(kept.column(c) for c in ("doc_id", "held_out", "row")),
                        pa.array(np.bincount(row, minlength=n) + 1),
                        pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), numbers.shape[1]).cast(pa.list_(pa.float64())),
                        pa.ListArray.from_arrays(ends, words.take(pa.array(pairs % max(1, len(words))))),
                        pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64))),
                    ],
                    ["doc_id", "held_out", "row", "n_tokens", "sums", "rare", "counts"],
                )

    return run


def _discount(n1: int, n2: int) -> float:
    return min(max(n1 / (n1 + 2 * n2), 0.01), 0.99) if n1 else 0.5


def score_documents(docs: DataFrame, held_out, vocabulary: str, label: str | None = None, components: int = 8, hot: int = 100_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text).

    held_out: a Column of docs. label: a column whose ``components`` - 1 most frequent values
    in the training documents get a component each.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"))
    train = rows.filter(~F.col("held_out") & F.col("label").isNotNull())
    values = [r["label"] for r in train.groupBy("label").count().orderBy(F.desc("count"), "label").limit(components - 1).collect()] if label else []
    number = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)]), F.col("label")), F.lit(len(values))) if values else F.lit(0)
    ks = range(len(values) + 1)
    names = [f"n{k}" for k in ks]

    k = F.when(F.col("held_out"), F.lit(-1)).otherwise(number).cast("int")
    schema = "word binary, " + ", ".join(f"{c} long" for c in names)
    counted = rows.select("text", k.alias("k")).mapInArrow(_count_words(len(names)), schema).groupBy("word").agg(*[F.sum(c).alias(c) for c in names])
    words = counted.mapInArrow(_with_scores(vocabulary), f"{schema}, piece_logp double").withColumn("n", sum((F.col(c) for c in names), F.lit(0)))
    words = common.cut(words, "lm-words")
    is_end = F.col("word") == F.lit(bytearray(END))
    zero = lambda c: F.coalesce(c, F.lit(0))
    stat = lambda c: [zero(F.sum(c)).alias(f"{c}_N"), zero(F.sum((F.col(c) > 0).cast("long"))).alias(f"{c}_V"), zero(F.sum((F.col(c) == 1).cast("long"))).alias(f"{c}_1"), zero(F.sum((F.col(c) == 2).cast("long"))).alias(f"{c}_2"), zero(F.sum(F.when(is_end, F.col(c)))).alias(f"{c}_end")]
    stats = words.agg(*[x for c in ("n", *names) for x in stat(c)]).first()
    total, distinct = stats["n_N"], stats["n_V"]
    used = [k for k in ks if stats[f"n{k}_N"]]
    discount = {k: _discount(stats[f"n{k}_1"], stats[f"n{k}_2"]) for k in used}
    # the mass that discounting leaves, at least a trace, goes to words the component hasn't seen
    spare = {k: max(discount[k] * stats[f"n{k}_V"] / stats[f"n{k}_N"], 1e-6) for k in used}
    prior = {k: math.log10(stats[f"n{k}_end"] / stats["n_end"]) for k in used} or {0: 0.0}

    def word_logp(k: int):
        """log10 of a word's arcs in a component: the whole word's own, and the rest of the mass over the others."""
        pieces = F.col("piece_logp") / F.lit(LN10)
        if k not in used:
            return pieces
        whole = F.greatest(F.col(f"n{k}") - F.lit(discount[k]), F.lit(0.0)) / F.lit(float(stats[f"n{k}_N"])) + F.lit(spare[k] * ELSEWHERE / max(1.0, float(total))) * F.col("n")
        rest = F.lit(math.log10(spare[k] * (1 - ELSEWHERE))) + pieces
        # the sum of both, in log space
        high = F.greatest(F.log10(whole), rest)
        return F.when(whole <= 0, rest).otherwise(high + F.log10(F.pow(F.lit(10.0), F.log10(whole) - high) + F.pow(F.lit(10.0), rest - high)))

    base = F.log10((F.col("n") + 0.1) / F.lit(total + 0.1 * (distinct + 1)))
    scored = words.filter(~is_end).select("word", "n", (F.col("n") > 0).cast("double").alias("known"), base.alias("base"), *[word_logp(k).alias(f"lm{k}") for k in prior])
    columns = ["known", "base", *[f"lm{k}" for k in prior]]
    # frequent words: the highest classes of counts (64 to an octave) that hold `hot` words at most
    octave = F.floor(F.log2(F.col("n").cast("double")) * 64)
    room, floor = hot, None
    for r in words.filter(~is_end & (F.col("n") > 0)).groupBy(octave.alias("o")).count().orderBy(F.desc("o")).collect():
        room -= r["count"]
        if room < 0:
            break
        floor = r["o"]
    found = scored.filter((F.col("n") > 0) & (octave >= floor)).toArrow() if floor is not None else None
    numbers = np.stack([found.column(c).to_numpy() for c in columns], 1) if found is not None else np.empty((0, len(columns)))
    shared = spark.sparkContext.broadcast((found.column("word").to_pylist() if found is not None else [], numbers))
    first = rows.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "held_out", "row", "text").mapInArrow(_first_pass(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, row long, n_tokens long, sums array<double>, rare array<binary>, counts array<long>")
    first = common.cut(first, "lm-docs")  # also fixes the row numbers
    shared.destroy()
    rare = first.select("row", F.explode(F.arrays_zip("rare", "counts")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.counts").alias("times"))
    cold = scored.filter((F.col("n") == 0) | (octave < floor)) if floor is not None else scored
    sums = rare.join(cold.drop("n"), "word").groupBy("row").agg(*[F.sum(F.col("times") * F.col(c)).alias(f"_{c}") for c in columns])
    both = first.drop("rare", "counts").join(sums, "row", "left").select("doc_id", "held_out", "n_tokens", *[(F.col("sums")[i] + zero(F.col(f"_{c}"))).alias(c) for i, c in enumerate(columns)])
    end_base = math.log10((stats["n_end"] + 0.1) / (total + 0.1 * (distinct + 1)))
    whole = [F.col(f"lm{k}") + F.lit(prior[k] + (math.log10((stats[f"n{k}_end"] - discount[k]) / stats[f"n{k}_N"]) if k in used else math.log10(0.5))) for k in prior]
    top = F.greatest(*whole) if len(whole) > 1 else whole[0]
    score = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in whole), F.lit(0.0)))
    return both.select("doc_id", "held_out", "n_tokens", (F.round("known").cast("long") + F.lit(int(stats["n_end"] > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.lit(end_base)).alias("base_score"), score.alias("score"))
