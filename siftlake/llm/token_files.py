"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by doc_id. Each task encodes its documents and writes two
flat files to the shared folder: ``part-N.ids`` (unsigned 16 or 32 bit, by vocabulary size)
and ``part-N.off`` (signed 64-bit little-endian, one offset per document and one past the
last, counted from the part's own start). A part's base is the prefix sum of the ids in the
parts before it, so no task needs another's data. Readers memory-map both files.

Texts are cut where the tokenizer's own pattern always cuts, whatever comes before or after:
before white space, and after it too except that a last space stays with the word it leads;
and between an ASCII letter and a mark other than the apostrophe.
Distinct segments are encoded once per task, many at a time, joined by line ends, which are
tokens of their own there, or, where the pattern takes them whole, by the model alone; so the
ids of the segments, one after another, are the ids of the whole text. Texts with other white space than spaces and line ends, or with the string of a
special token, are encoded whole.

Defined results: null text is an empty text (only the end id); null doc_id sorts first;
equal doc_ids are ordered by the text's hash; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, segments

#: What the tokenizer's own pattern takes as white space, besides space and line end.
OTHER_SPACE = r"\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A segment that may stand between line ends: visible characters, led by a space at most.
PLAIN = f"^ ?[^ \\n{OTHER_SPACE}]+$"
#: Letters, and marks that the pattern never takes with a letter before them: all ASCII ones but the apostrophe.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
#: A segment that the pattern takes whole: letters of the Latin and Cyrillic blocks, or digits.
ONE_CLASS = r"^ ?(?:[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{400}-\x{481}]+|[0-9]+)$"
#: Segments of one call.
_JOINED = 2000


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable ones as they are, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = itertools.count(256)
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class Encoder:
    """Encodes columns of texts to little-endian ids."""

    def __init__(self, tokenizer_path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = end_id
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = f"[{OTHER_SPACE}]" + f"|{self.special}" * bool(self.special)
        state = json.loads(self.tokenizer.to_str())
        split, line = state["pre_tokenizer"] or {}, self.tokenizer.encode("\n", add_special_tokens=False).ids
        #: Whether texts may be cut: tokenizers with another pattern encode every text whole.
        self.cuts = state["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and len(line) == 1
        self.line = line[0] if line else None
        self.words, self.letters = Tokenizer(self.tokenizer.model), str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.memo = segments.Memo(self._code)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments that the pattern takes whole, and how many each has: the model alone splits them."""
        letters = "\n".join(words).encode("utf-8").decode("latin-1").translate(self.letters).split(self.letters[10])
        got = self.words.encode(letters, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, self.dtype), np.bincount(np.array(got.word_ids, np.int64), minlength=len(words))

    def _lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments that may stand between line ends."""
        (ids,) = self._ids(["\n".join(words)])
        inner = np.flatnonzero(ids == self.line)
        if len(inner) == len(words) - 1:
            return ids[ids != self.line], np.diff(np.concatenate([[-1], inner, [len(ids)]])) - 1
        return self._whole(words)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = self._ids(texts)
        return np.concatenate([*parts, np.empty(0, self.dtype)]), np.array([len(x) for x in parts], np.int64)

    def _code(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments."""
        found = found.cast(pa.string())
        single, plain = (pc.match_substring_regex(found, p).to_numpy(zero_copy_only=False) & self.cuts for p in (ONE_CLASS, PLAIN))
        if self.special:
            plain &= ~pc.match_substring_regex(found, self.special).to_numpy(zero_copy_only=False)
        values, lengths, order = [np.empty(0, self.dtype)], [np.empty(0, np.int64)], []
        for rows, code in ((np.flatnonzero(single), self._single), (np.flatnonzero(plain & ~single), self._lines), (np.flatnonzero(~plain & ~single), self._whole)):
            words = found.take(pa.array(rows)).to_pylist()
            for at in range(0, len(rows), _JOINED):
                ids, n = code(words[at : at + _JOINED])
                values.append(ids)
                lengths.append(n)
            order.append(rows)
        offsets, back = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), np.empty(len(found), np.int64)
        back[np.concatenate(order)] = np.arange(len(found))
        values, lengths = segments.gather(back, offsets, np.concatenate(values))
        return np.concatenate([[0], np.cumsum(lengths)]), values

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each with the end id, one after another, and how many each has."""
        run, at = segments.flat(texts)
        space = (run == 32) | (run == 10)
        # the last white space of a run, where a visible character follows in the same text
        last = np.zeros(len(run), bool)
        last[:-1] = space[:-1] & ~space[1:]
        inner = at[1:-1]
        last[inner[(inner > 0) & (inner < len(run))] - 1] = False
        cuts = last.copy()
        cuts[1:] |= last[:-1] & (run[:-1] == 10)
        cuts[1:] |= (space[1:] & ~space[:-1]) | (_MARK[run[1:]] & _LETTER[run[:-1]])
        whole = pc.match_substring_regex(texts, self.whole).fill_null(False).to_numpy(zero_copy_only=False) | (not self.cuts)
        for row in np.flatnonzero(whole):
            cuts[at[row] : at[row + 1]] = False
        sizes = np.diff(at)
        cuts[at[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cuts)
        index, offsets, values = self.memo.of(segments.segments(run, starts))
        ids, lengths = segments.gather(index, offsets, values)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, at)]
        n = np.diff(ends)
        out = np.full(len(ids) + len(n), self.end, self.dtype)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
        return out, n + 1


def _open(folder: str, name: str, mode: str):
    """A file of the shared folder; other schemes than file go through Arrow's file systems."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        os.makedirs(url.path, exist_ok=True)
        return open(f"{url.path}/{name}", mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    return system.open_output_stream(f"{path}/{name}") if "w" in mode else system.open_input_file(f"{path}/{name}")


def _rename(folder: str, old: str, new: str) -> None:
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        os.replace(f"{url.path}/{old}", f"{url.path}/{new}")
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.move(f"{path}/{old}", f"{path}/{new}")


def _mapped(folder: str, name: str, dtype: str, first: int = 0, last: int | None = None) -> np.ndarray:
    """Entries first to last of a file: memory-mapped where it is local, else only that range is fetched."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        path = f"{url.path}/{name}"
        return np.memmap(path, dtype, "r")[first:last] if os.path.getsize(path) else np.empty(0, dtype)
    width = np.dtype(dtype).itemsize
    with _open(folder, name, "rb") as f:
        last = f.size() // width if last is None else last
        f.seek(first * width)
        return np.frombuffer(f.read((last - first) * width), dtype)


def _writer(tokenizer_path: str, end_id: int, folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = Encoder(tokenizer_path, end_id), TaskContext.get()
        part, at, row, offsets = context.partitionId(), 0, 0, [0]
        own = f"part-{part:06d}-{context.taskAttemptId()}"
        with _open(folder, f"{own}.tmp", "wb") as f:
            for batch in batches:
                texts, lengths = batch.column("text"), []
                for first, last in segments.slices(texts):
                    ids, n = encoder.encode(texts.slice(first, last - first))
                    f.write(ids.tobytes())
                    lengths += n.tolist()
                offsets += (at + np.cumsum(lengths)).tolist()
                at = offsets[-1]
                n = len(lengths)
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "part": pa.array([part] * n, pa.int32()), "row": pa.array(range(row, row + n), pa.int64()), "file": pa.array([own] * n), "ids": pa.array(lengths, pa.int64())})
                row += n
        with _open(folder, f"{own}.off.tmp", "wb") as f:
            f.write(np.array(offsets, "<i8").tobytes())
        _rename(folder, f"{own}.tmp", f"{own}.ids")
        _rename(folder, f"{own}.off.tmp", f"{own}.off")

    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode docs(doc_id, text) into flat files in ``folder``; returns the index (doc_id, part, row, file, ids, base).

    The names hold the attempt, so a retried or doubled task never touches files that the
    index points to; leftovers of lost attempts are not in the index.
    """
    spark = docs.sparkSession
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(common.shuffle_parts(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    index = common.cut(dealt.mapInArrow(_writer(tokenizer_path, end_id, folder), f"doc_id {dict(docs.dtypes)['doc_id']}, part int, row long, file string, ids long"), "token-index")
    parts = index.groupBy("part").agg(F.sum("ids").alias("n"))
    # one row a part: the window sorts as many rows as there were tasks
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    return index.join(F.broadcast(bases), "part")


def _reader(folder: str, width: int):
    def read(frames):
        kind = f"<u{width}"
        for pdf in frames:
            out = []
            for (file, base), rows in pdf.groupby(["file", "base"], sort=False):
                row, low = rows["row"].to_numpy(), int(rows["row"].min())
                offsets = _mapped(folder, f"{file}.off", "<i8", low, int(row.max()) + 2)
                start, end = offsets[row - low], offsets[row - low + 1]
                ids = _mapped(folder, f"{file}.ids", kind, int(offsets[0]), int(offsets[-1]))
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip((start - offsets[0]).tolist(), (end - offsets[0]).tolist(), strict=True)]
                out.append(rows[["doc_id"]].assign(start=int(base) + start, n_tokens=end - start, ids_crc32=crc))
            yield from out

    return read


def read_token_files(index: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """Per document from the memory-mapped files: doc_id, start, n_tokens, ids_crc32 (ids as 32-bit little-endian)."""
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    return index.select("doc_id", "file", "row", "base").mapInPandas(_reader(folder, width), f"doc_id {dict(index.dtypes)['doc_id']}, start long, n_tokens long, ids_crc32 long")
