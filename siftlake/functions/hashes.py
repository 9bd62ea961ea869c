"""Content digests, 64-bit similarity hashes and their distances, as columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_GAP = r"[^\p{L}\p{N}_]+"
#: So many characters mostly hold a text's first words.
START = 400


def tokens(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.filter(F.split(F.lower(text), TOKEN_GAP), lambda w: w != "")


def first_words(text: Column, n: int) -> Column:
    """The first n of ``tokens``. Few texts need more than their start to be looked at."""
    start = F.substr(text, F.lit(1), F.lit(START))
    pieces = lambda t: F.split(F.lower(t), TOKEN_GAP, n + 2)
    # before the first word there may be an empty piece, and the last one is the rest
    words = lambda t: F.slice(F.filter(F.slice(pieces(t), 1, n + 1), lambda w: w != ""), 1, n)
    enough = (F.octet_length(start) == F.octet_length(text)) | ((F.size(pieces(start)) == n + 2) & (F.element_at(pieces(start), -1) != ""))
    return F.when(enough, words(start)).otherwise(words(text))


def content_digest(content: Column, algorithm: str = "sha1") -> Column:
    return {"sha1": F.sha1, "md5": F.md5, "sha256": lambda c: F.sha2(c, 256)}[algorithm](content)


def word_hash(word: Column, salt: str = "") -> Column:
    """First 64 bits of the digest of a word, as a signed bit pattern."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), word)), 1, 16), 16, -10).cast("long")


def majority_hashes(salts: dict[str, str]):
    """A function of arrays of distinct words: by name, the hash whose bits are set where more than half of the words' hashes have them, null without words. A batch hashes each of its words once a salt."""

    prefixes = [salt.encode() for salt in salts.values()]

    def run(words: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.flatnonzero(lengths)
        coded = words.flatten().dictionary_encode()
        ids, known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary()).to_pylist()
        counts = np.zeros((len(lengths), 64 * len(salts)), np.int32)
        if len(rows):
            first = b"".join(hashlib.md5(salt + w).digest()[:8] for w in known for salt in prefixes)
            # a byte a bit, eight of them to a number: such numbers add up without a carry while they are 255 at most, so rows are summed in runs of so many words
            lanes = np.unpackbits(np.frombuffer(first, np.uint8)).reshape(len(known), -1).view(np.uint64)
            runs = -(-lengths[rows] // 255)
            of = np.cumsum(runs) - runs
            starts = np.repeat(np.cumsum(lengths[rows]) - lengths[rows], runs) + 255 * (np.arange(runs.sum()) - np.repeat(of, runs))
            sums = np.empty((len(starts), lanes.shape[1]), np.uint64)
            for k in range(0, len(starts), 64):
                part, end = starts[k : k + 64], starts[k + 64] if k + 64 < len(starts) else len(ids)
                sums[k : k + 64] = np.add.reduceat(lanes[ids[part[0] : end]], part - part[0], axis=0)
            counts[rows] = np.add.reduceat(sums.view(np.uint8), of, axis=0, dtype=np.int32)
        found = np.packbits(counts * 2 > lengths[:, None], axis=1).view(">i8").astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(found[:, k], mask=lengths == 0) for k in range(len(salts))], names=list(salts))

    return F.arrow_udf(run, ", ".join(f"{name} long" for name in salts))


def character_statistics():
    """A function of texts: mean code point and entropy of their characters; null without characters."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            if not text:
                out.append(None)
                continue
            points, total = np.frombuffer(text.encode("utf-32-le"), np.uint32), len(text)
            # few texts have characters beyond these, for which a table of all would be large
            counts = np.bincount(points) if points.max() < 1 << 13 else np.unique(points, return_counts=True)[1]
            counts = counts[counts > 0]
            out.append({"mean": int(points.sum(dtype=np.int64)) / total, "entropy": float(np.log2(total) - (counts * np.log2(counts)).sum() / total)})
        return pa.array(out, pa.struct([("mean", pa.float64()), ("entropy", pa.float64())]))

    return F.arrow_udf(run, "mean double, entropy double")


def hamming64(a: Column, b: Column) -> Column:
    """Number of differing bits; null where either is missing."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hash_from_text(text: Column) -> Column:
    """Unsigned decimal text to a signed bit pattern; null where it isn't a number of 64 bits."""
    fits = text.rlike("^[0-9]+$") & (F.try_to_number(F.lpad(text, 20, "0"), F.lit("9" * 20)) <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    return F.when(F.length(text) <= 20, F.when(fits, F.conv(text, 10, -10).cast("long")))


def clean_hash_text(text: Column) -> Column:
    """Placeholders of a missing hash become null."""
    return F.nullif(F.nullif(text, F.lit("undefined")), F.lit(""))


def gradient_hash(grid: Column, width: int = 8) -> Column:
    """Difference hash of a row-major grid: bit i is set where a cell is below its right neighbour (cyclic in the row)."""
    n = width * width

    def bit(i: Column) -> Column:
        right = F.when(i % width == width - 1, i - width + 1).otherwise(i + 1)
        return F.when(F.get(grid, i) < F.get(grid, right), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), bit), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))
