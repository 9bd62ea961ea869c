"""Texts as arrays: a column of texts is cut into segments at once, and each distinct segment is coded once.

A slice of a column is one run of bytes with the offsets of its texts. Cuts are positions in
that run; the segments between them are dictionary-encoded by Arrow, and what a segment codes
to (ids, scores) is computed for distinct segments only and gathered back by number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE = 4 << 20


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield at, end
        at = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each, with the end; a null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    run = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return run, at - at[0]


def segments(run: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """The pieces of a run from each start to the next one, or, if ``ends`` are given, to its end; runs stay under 2 GB."""
    if ends is None:
        offsets = np.append(starts, len(run)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(run)])
    # starts and ends alternate; every second piece is a gap
    both = np.empty(2 * len(starts) + 1, np.int32)
    both[0:-1:2], both[1::2], both[-1] = starts, ends, len(run)
    return pa.Array.from_buffers(pa.binary(), 2 * len(starts), [None, pa.py_buffer(both), pa.py_buffer(run)]).take(pa.array(np.arange(0, 2 * len(starts), 2)))


def gather(index: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value lists of the indexed entries one after another, and the length of each."""
    lengths = np.diff(offsets)[index]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(offsets[:-1][index] - ends + lengths, lengths) + np.arange(total)], lengths


def joined(lists: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of lists."""
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return offsets, np.concatenate(lists).astype(dtype) if lists else np.empty(0, dtype)


class Memo:
    """Codes of distinct segments, kept for the task up to ``most`` bytes; then it starts anew.

    code: an array of distinct segments -> offsets and values.
    """

    def __init__(self, code: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int = 24 << 20):
        self.code, self.most = code, most
        self.known: pa.Array | None = None
        self.offsets = self.values = None

    def of(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A number for each segment, and the offsets and values that numbers refer to."""
        coded = found.dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        if self.known is None:
            self.known, (self.offsets, self.values) = words, self.code(words)
            return index, self.offsets, self.values
        at = pc.index_in(words, value_set=self.known)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        if missing.any():
            new = words.filter(pa.array(missing))
            offsets, values = self.code(new)
            number = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            number[missing] = len(self.known) + np.arange(len(new))
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
            self.values = np.concatenate([self.values, values])
            self.known = pa.concat_arrays([self.known, new])
        else:
            number = at.to_numpy(zero_copy_only=False)
        out = number[index], self.offsets, self.values
        if self.known.nbytes + self.offsets.nbytes + self.values.nbytes > self.most:
            self.known = self.offsets = self.values = None
        return out
