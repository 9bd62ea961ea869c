"""Near-duplicate classes by order MinHash, verified by banded alignment.

Two documents are linked when the edit similarity of their word sequences, 1 - distance /
longer length, is 0.8 or more; classes are the connected components of the links.

Sketch: a document's k-mers are its runs of five words, each labelled with its occurrence
number. Every one of ``sketches`` hash functions picks the two labelled k-mers of least hash
and keeps them in the order of the text; the ordered pair is the sketch's key, so that
reordered texts don't meet. Texts of any length add ``triples`` sketches of three two-word
k-mers, as changes spread over a text may leave no run of five words whole. Documents of up to
48 words add sketches of pairs of two-word k-mers and those of up to 12 words of single words.

Candidates: equal texts are one node. Nodes that share a key meet in a bucket. Each node is
first aligned with the bucket leader it shares most keys with, then with other leaders of
its buckets where those are in another component. What is still apart in a bucket is compared
across components: in buckets of up to ``bucket`` nodes pair by pair. The nodes of larger ones
meet by their words: texts of similarity 0.8 hold 0.8 of the longer one's words in common, so
that, in any fixed order of words, they share one of the first fifth and one more of each
other's. Words are ordered by how rare they are there; nodes that share such a word and a bucket
are a pair, unless lengths and the word's place rule it out. This leaves out no pair that a
comparison of the whole bucket would link, and its work grows with the words, not with the
square of the bucket. A word that more than ``block`` nodes lead with is dealt in blocks, each
pair of blocks a group of its own.

The candidate search is probabilistic: a pair is lost if no sketch agrees. With k-mer
Jaccard J a sketch of m k-mers agrees with about J^m. Where every fifth word differs
(similarity 0.8) no k-mer of five is shared and J is 3/7 for those of two: 64 triples miss 1
pair in 200. Every sixth word: J = 1/2, 1 in 5,000; a fifth of the words at random: J = 0.47,
1 in 1,000. Classes of several members have other links to hold them.

Defined results: a null text is in a class of its own; texts without words are one class;
equal rows share a class; class_id is the least doc_id of the class (null only if all are
null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 5
#: Bits of the number of slots that words are counted in; words before its own that a row of ``_leading_words`` carries.
_SLOTS, _BEFORE = 18, 4
#: Parts by key that shared keys are looked for in, one after another: only one part's shuffles lie on disk.
_SLICES = 4
#: The same for texts that are dealt to be sketched, and for leading words that nodes of large buckets meet by.
_TEXT_SLICES, _WORD_SLICES = 2, 2
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def labelled_kmers(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of a sequence of word hashes, without and with their occurrence number; shorter sequences are one k-mer."""
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(31) + words[i : len(words) - k + 1 + i])
    order = np.argsort(h, kind="stable")
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = (np.arange(len(h)) - first).astype(np.uint64)
    return h, mix(h + occurrence * np.uint64(0x9E3779B97F4A7C15))


def sketch(words: np.ndarray, sketches: int, k: int, picks: int = 2) -> np.ndarray:
    """A key for each hash function: the ``picks`` (two or three) least labelled k-mers in text order; 32 bits order them, 64 name them."""
    h, labelled = labelled_kmers(words, k)
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 16 * (picks - 2)))
    v = ((labelled >> np.uint64(32)).astype(np.uint32)[None] ^ (seeds >> np.uint64(32)).astype(np.uint32)[:, None]) * np.uint32(0x85EBCA6B)
    v ^= v >> np.uint32(15)
    v *= np.uint32(0x9E3779B1)
    at, top = np.arange(sketches), np.uint32(0xFFFFFFFF)
    one = v.argmin(1)
    v[at, one] = top
    two = v.argmin(1) if len(h) > 1 else one
    if picks == 2:
        first, second = labelled[np.minimum(one, two)], labelled[np.maximum(one, two)]
        return mix(mix(first * np.uint64(3) + seeds) + second).astype(np.int64)
    v[at, two] = top
    three = v.argmin(1) if len(h) > 2 else two
    first, second, third = labelled[np.sort(np.stack([one, two, three]), 0)]
    return mix(mix(mix(first * np.uint64(3) + seeds) + second) + third).astype(np.int64)


def aligned_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences by bit-parallel alignment in a band of 2 * most + 1 diagonals; most + 1 if it is larger."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if not m or not n:
        return max(m, n)
    t = min(most, max(m, n))
    at: dict[int, int] = {}
    for r, w in enumerate(a, 1):
        at[w] = at.get(w, 0) | 1 << r
    # bit i of column j stands for row j - t + i
    mask = (1 << 2 * t + 1) - 1
    top = 1 << 2 * t
    vp, vn, distance = mask & ~((1 << t) - 1), 0, min(m, t)
    for j, w in enumerate(b, 1):
        rows = at.get(w, 0)
        eq = (rows >> j - t if j >= t else rows << t - j) & mask
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = vn | (mask & ~(d0 | vp))
        hn = d0 & vp
        if j + t <= m:
            distance += not d0 & top
        else:
            row = 1 << m - j + t
            distance += bool(hp & row) - bool(hn & row)
        vp, vn = hn | (mask & ~((d0 >> 1) | hp)), (d0 >> 1) & hp
    return min(distance, most + 1)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the edit similarity of two sequences is at least ``least``."""
    longer = max(len(a), len(b))
    most = math.floor((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) == len(b) and (a == b).all():
        return True
    x, y = a.tolist(), b.tolist()
    if longer - (Counter(x) & Counter(y)).total() > most:
        return False
    return aligned_distance(x, y, most) <= most


def _word_hashes():
    """Text -> hashes of its lower-cased words, with a cache of words for the task."""
    import xxhash

    class Known(dict):
        def __missing__(self, w):
            if len(self) > 200_000:
                self.clear()
            self[w] = got = xxhash.xxh64_intdigest(w)
            return got

    known = Known()
    return lambda text: np.array([known[w] for w in text.encode("utf-8", "replace").lower().split()], np.uint64)


def _sketcher(sketches: int, triples: int):
    def run(batches):
        hashes = _word_hashes()
        for batch in batches:
            n, words, keys = [], [], []
            for text in batch.column("text"):
                w = hashes(text.as_py())
                n.append(len(w))
                words.append(w.astype(np.uint32).tobytes())
                own = [np.zeros(1, np.int64)] if not len(w) else [sketch(w, sketches, K), sketch(w, triples, 2, 3)]
                own += [sketch(w, sketches, k) for k, longest in ((2, 48), (1, 12)) if 0 < len(w) <= longest]
                keys.append(np.concatenate(own))
            yield pa.record_batch({"node": batch.column("node"), "n": pa.array(n, pa.int32()), "words": pa.array(words, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return run


def _aligner(least: float):
    def run(batches):
        for batch in batches:
            kept = [similar(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32), least) for a, b in zip(batch.column("wa"), batch.column("wb"), strict=True)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(kept, pa.bool_()))

    return run


def _labelled_words(words: bytes) -> np.ndarray:
    """A 64-bit key for each word of a text; the second occurrence of a word is a word of its own."""
    found = np.frombuffer(words, np.uint32).astype(np.uint64)
    return labelled_kmers(found, 1)[1] if len(found) else found


def _slots(labelled: np.ndarray) -> np.ndarray:
    return (labelled >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _slot_counts(batches):
    """How many words of a task's nodes fall into each slot of a fixed number of them."""
    counts = np.zeros(1 << _SLOTS, np.int64)
    for batch in batches:
        found = [_slots(_labelled_words(w.as_py())) for w in batch.column("words")]
        counts += np.bincount(np.concatenate([*found, np.empty(0, np.int64)]), minlength=1 << _SLOTS)
    at = np.flatnonzero(counts)
    for k in range(0, len(at), 100_000):
        yield pa.record_batch({"slot": pa.array(at[k : k + 100_000].astype(np.int32)), "n": pa.array(counts[at[k : k + 100_000]])})


def _leading_words(shared, least: float, over: int | None = None):
    """A row for each of the rarest words of a node, as many as similar texts can lack and one more, with the few before it.

    With ``over``: the words alone, of slots that count more than that.
    """

    def run(batches):
        counts = shared.value
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                of, word, n, place, before = [], [], [], [], []
                for row, words in enumerate(part.column("words")):
                    labelled = _labelled_words(words.as_py())
                    count = counts[_slots(labelled)]
                    lead = math.floor((1 - least) * len(labelled) + 1e-9) + 1
                    order = np.lexsort((labelled, count))[:lead]
                    first = labelled[order].view(np.int64)
                    pos = np.flatnonzero(count[order] > over) if over else np.arange(len(order))
                    of.append(np.full(len(pos), row))
                    word.append(first[pos])
                    n.append(np.full(len(pos), len(labelled), np.int32))
                    place.append(pos.astype(np.int32))
                    before += [first[max(0, k - _BEFORE) : k].tobytes() for k in pos.tolist()]
                of, word = pa.array(np.concatenate(of)), pa.array(np.concatenate(word))
                if over:
                    yield pa.RecordBatch.from_arrays([word], ["word"])
                    continue
                columns = [word, *(part.column(c).take(of) for c in ("node", "comp", "keys")), pa.array(np.concatenate(n)), pa.array(np.concatenate(place)), pa.array(before, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "node", "comp", "keys", "n", "pos", "before"])

    return run


def _meeting(least: float):
    """Pairs (a, b) of different components that share a bucket, out of rows sorted by group.

    A pair comes at the first word that both lead with, and at a later one only where neither
    row carries the one before.
    """

    def pairs(t: pa.Table):
        group = np.stack([t.column(c).to_numpy() for c in ("word", "low", "high")], 1)
        new = np.concatenate([[True], (group[1:] != group[:-1]).any(1)])
        of, nodes = np.cumsum(new), t.column("node").combine_chunks()
        comp, n, pos, piece = (t.column(c).to_numpy() for c in ("comp", "n", "pos", "piece"))
        within = group[:, 1] == group[:, 2]
        earlier = np.zeros((len(t), _BEFORE), np.int64)
        for row, b in zip(earlier, t.column("before").to_pylist(), strict=True):
            row[: len(b) // 8] = np.frombuffer(b, np.int64)
        keys = [frozenset(k) for k in t.column("keys").to_pylist()]
        for step in range(1, int(np.bincount(of).max())):
            i = np.flatnonzero(of[step:] == of[:-step])
            j = i + step
            longer = np.maximum(n[i], n[j])
            need = longer - np.floor((1 - least) * longer + 1e-9)
            ok = (comp[i] != comp[j]) & (within[i] | (piece[i] != piece[j])) & (1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= need)
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 20_000):
                x, y = earlier[i[k : k + 20_000]], earlier[j[k : k + 20_000]]
                met = ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] != 0)).any((1, 2))
                x, y = i[k : k + 20_000][~met], j[k : k + 20_000][~met]
                together = np.array([not keys[p].isdisjoint(keys[q]) for p, q in zip(x.tolist(), y.tolist(), strict=True)], bool)
                a, b = (nodes.take(pa.array(z[together])).to_pylist() for z in (x, y))
                if a:
                    yield pa.record_batch({"a": pa.array(list(map(min, a, b)), pa.binary()), "b": pa.array(list(map(max, a, b)), pa.binary())})

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            last = tuple(t.column(c)[-1].as_py() for c in ("word", "low", "high")) if len(t) else None
            # the last group may go on in the next batch
            at = len(t)
            while at and tuple(t.column(c)[at - 1].as_py() for c in ("word", "low", "high")) == last:
                at -= 1
            if at:
                yield from pairs(t.slice(0, at))
            held = t.slice(at)
        if held is not None and len(held):
            yield from pairs(held)

    return run


def met_by_words(members: DataFrame, nodes: DataFrame, least: float, block: int) -> DataFrame:
    """Pairs a, b across components of members(node, comp, keys) that share a key and one of the rarest words of both, after bounds."""
    context = members.sparkSession.sparkContext
    held = common.cut(nodes.select("node", "words").join(members, "node").select("node", F.xxhash64("comp").alias("comp"), "keys", "words"), "met-nodes")
    # a fixed number of slots, so that the driver's table doesn't grow
    counted = held.select("words").mapInArrow(_slot_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << _SLOTS, np.uint32)
    counts[counted.column("slot").to_numpy()] = np.minimum(counted.column("n").to_numpy(), (1 << 32) - 1)
    shared = context.broadcast(counts)
    rows = held.mapInArrow(_leading_words(shared, least), "word long, node binary, comp long, keys array<int>, n int, pos int, before binary")
    rows, often, few = rows.withColumn("pieces", F.lit(1)), None, True
    if counts.max(initial=0) > block:
        often = held.mapInArrow(_leading_words(shared, least, block), "word long").groupBy("word").agg(F.count("*").alias("of")).filter(F.col("of") > block)
        often = common.cut(often.select("word", F.ceil(F.col("of") / F.lit(block)).cast("int").alias("pieces")), "met-often")
        few = often.count() <= 100_000

    def met_in(part: int) -> DataFrame:
        # a group is one word's, so groups of one part are whole
        own = rows.filter(F.pmod(F.xxhash64("word"), F.lit(_WORD_SLICES)) == part)
        if often is not None:
            own = own.drop("pieces").join(F.broadcast(often) if few else often, "word", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        own = own.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        dealt = own.select("word", F.least("piece", "with").alias("low"), F.greatest("piece", "with").alias("high"), "piece", "node", "comp", "keys", "n", "pos", "before")
        dealt = dealt.repartition("word", "low", "high").sortWithinPartitions("word", "low", "high")
        return common.cut(dealt.mapInArrow(_meeting(least), "a binary, b binary"), "met")

    return functools.reduce(DataFrame.unionByName, [met_in(k) for k in range(_WORD_SLICES)])


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for the nodes of edges(a, b): least labels spread, with pointer jumping."""
    both = common.cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = common.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels")
    held = labels
    while True:
        spread = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near")).select(F.col("a").alias("node"), "near")
        least = labels.join(spread, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = least.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("further")), "comp", "left")
        new = common.cut(jump.select("node", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "old"), "labels")
        common.drop(held)
        done, held = new.filter(F.col("comp") != F.col("old")).isEmpty(), new
        labels = new.select("node", "comp")
        if done:
            common.drop(both)
            return labels


def near_duplicates(docs: DataFrame, least: float = 0.8, sketches: int = 40, triples: int = 64, bucket: int = 4, block: int = 4096) -> DataFrame:
    """doc_id, class_id, class_size of docs(doc_id, text)."""
    rows = docs.select("doc_id", "text", common.text_key().alias("node"))
    # one text a node; the longest tables from here on hold one row a key

    def sketched(part: int) -> DataFrame:
        own = rows.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("node"), F.lit(_TEXT_SLICES)) == part))
        texts = own.groupBy("node").agg(F.first("text").alias("text"))
        return texts.select("node", "text").mapInArrow(_sketcher(sketches, triples), "node binary, n int, words binary, keys array<long>")

    slices = [common.cut_by(sketched(k), "node", "sketches") for k in range(_TEXT_SLICES)]
    nodes = functools.reduce(DataFrame.unionByName, slices)
    length = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(-math.log(least))).cast("int")
    # a key is of one hash function only, as its seed is part of it
    members = nodes.select("node", F.explode("keys").alias("key"))

    def shared_in(part: int) -> DataFrame:
        # dealt by key once, for the count and for the join: both look at all columns of the same rows, else the planner would deal them twice
        own = members.filter((F.pmod("key", F.lit(_SLICES)) == part) & F.col("node").isNotNull()).repartition("key")
        shared_keys = own.groupBy("key").agg(F.count_if(F.length("node") > 0).alias("size")).filter(F.col("size") > 1).select("key")
        return common.cut(own.join(shared_keys.hint("merge"), "key").join(nodes.select("node", "n", length.alias("length")), "node"), "shared-keys")

    parts = [shared_in(k) for k in range(_SLICES)]
    shared = functools.reduce(DataFrame.unionByName, parts)

    def words_alone():
        # keys take more room than words, and nothing looks at those of one node only any more; each slice goes once its words are copied
        for t in slices:
            yield t.select("node", "words")
            common.drop(t)

    words = common.cut_by(words_alone(), "node", "words")

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = words.select(F.col("node").alias("a"), F.col("words").alias("wa")), words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
        return common.cut(pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "wa", "wb").mapInArrow(_aligner(least), "a binary, b binary"), "links")

    def with_comp(t: DataFrame, comp: DataFrame) -> DataFrame:
        return t.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    # leaders: of each key and class of lengths the least node; similar lengths are in the same class or the next
    leaders = shared.groupBy("key", "length").agg(F.min("node").alias("leader"))
    leaders = leaders.withColumn("length", F.explode(F.array("length", F.col("length") + 1)))
    led = shared.join(leaders, ["key", "length"]).filter(F.col("leader") != F.col("node")).groupBy("node", "leader").agg(F.count("*").alias("votes"))
    led = common.cut(led, "leaders")
    best = led.groupBy("node").agg(F.max(F.struct("votes", F.col("leader"))).alias("x")).select(F.col("node").alias("a"), F.col("x.leader").alias("b"))
    edges = linked(best)
    comp = components(edges)
    named = comp.select(F.col("node").alias("leader"), F.col("comp").alias("other"))
    apart = with_comp(led, comp).join(named, "leader", "left").filter(F.col("comp") != F.coalesce("other", "leader")).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    apart = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = common.cut(edges.union(linked(apart.join(tried, ["a", "b"], "left_anti"))), "links")
    tried = common.cut(tried.union(apart), "tried")
    comp = components(edges)

    # nodes still apart within a bucket: small ones pair by pair, those of larger ones by their words
    level = with_comp(shared.select("key", "node", "n"), comp).repartition("key")
    # dealt once, as above
    mixed = level.groupBy("key").agg(F.count_if((F.length("node") > 0) & (F.col("n") >= 0)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter(F.col("low") != F.col("high")).select("key", "size")
    level = common.cut(level.join(mixed.hint("merge"), "key"), "buckets")
    common.drop(*parts, led)
    small = level.filter(F.col("size") <= bucket)
    other = small.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    crossed = small.select("key", F.col("node").alias("a"), "n", "comp").join(other, "key").filter((F.col("a") < F.col("b")) & (F.col("comp") != F.col("cb")) & (F.least("n", "nb") >= F.greatest("n", "nb") * least - 1e-9)).select("a", "b")
    # a node has as many keys as sketches at most; two keys of one hash only add a pair
    large = level.filter(F.col("size") > bucket).groupBy("node", "comp").agg(F.collect_set(F.hash("key")).alias("keys"))
    crossed = crossed.union(met_by_words(large, words, least, block)).distinct()
    more = linked(crossed.join(tried, ["a", "b"], "left_anti"))
    common.drop(words, level)
    if not more.isEmpty():
        comp = components(edges.union(more))

    named = with_comp(rows.filter(F.col("text").isNotNull()).select("doc_id", "node"), comp)
    sizes = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    own = rows.filter(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return named.join(sizes, "comp").select("doc_id", "class_id", "class_size").unionByName(own)
