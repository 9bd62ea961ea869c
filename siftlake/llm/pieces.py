"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi.

The automaton reads a text once. At every position the output links name all pieces that
end there; each relaxes the best score of the position by the best score at its start plus
its own, so no position is read twice. A character that no piece covers costs the lowest
score less ten, as the library has it, and becomes byte pieces where the vocabulary has all
256 of them, else the unknown piece.

Texts are normalized as the model file says: a space becomes the piece space mark, and, where
the model asks for it, one is put in front. The vocabulary file is a parameter; its scores
are used as they are. A text is cut wherever two of its bytes stand together in no piece, as
no piece can lie across; each distinct segment runs through the automaton once per task, and
the ids of the segments, one after another, are the ids of the whole text.

Decoding joins the pieces, turns runs of byte pieces back into text (malformed ones into the
replacement character) and takes off the front mark; decode(encode(x)) is x for any text
that doesn't hold the space mark itself, which decodes to a space as in the library.

Defined results: null text gives null ids and null text; an empty one no ids; very long
texts are encoded whole; repeated rows alike; an empty table gives no rows; other columns
pass through, but those named like a new one (piece_ids, decoded) are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import segments

MARK = "▁"


class PieceModel:
    """Pieces and scores of a vocabulary file, and the automaton over them."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = [-1] * 256
        self.kind = ["control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "byte" if model.is_byte(i) else "unused" if model.is_unused(i) else "text" for i in range(n)]
        for i, k in enumerate(self.kind):
            if k == "byte":
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        self.unknown = self.kind.index("unknown") if "unknown" in self.kind else 0
        self.fallback = all(b >= 0 for b in self.bytes)
        self.automaton = ahocorasick.Automaton()
        scores = [model.get_score(i) for i in range(n)]
        text = [i for i in range(n) if self.kind[i] == "text"]
        for i in text:
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i]), scores[i]))
        self.automaton.make_automaton()
        self.missing = min((scores[i] for i in text), default=0.0) - 10.0
        self.prefix = bool(model.encode("a")) and model.decode(model.encode("a")) == "a" and model.id_to_piece(model.encode("a")[0]).startswith(MARK)
        #: Pairs of bytes that some piece holds side by side; runs of unknown characters are one piece, so that without byte pieces nothing is cut.
        self.inside = np.full((256, 256), not self.fallback)
        for i in text:
            b = np.frombuffer(self.pieces[i].replace(MARK, " ").encode(), np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.inside[:, 0x80:0xC0] = True  # within a character
        back = [bytes([int(self.pieces[i][3:5], 16)]) if k == "byte" else "⁇".encode() if k == "unknown" else b"" if k == "control" else self.pieces[i].replace(MARK, " ").encode() for i, k in enumerate(self.kind)]
        self.back = np.concatenate([[0], np.cumsum([len(x) for x in back])]), np.frombuffer(b"".join(back), np.uint8)
        self.memo = segments.Memo(self._code)

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a normalized text; of equal ones the one whose last piece is longest."""
        n, low = len(text), float("-inf")
        best, back = [0.0] + [low] * n, [None] * (n + 1)
        found = self.automaton.iter(text)
        ended, hits = next(found, (n, None))
        for at in range(n):
            single = False
            x, from_ = low, None
            while ended == at:
                i, length, score = hits
                single |= length == 1
                y = best[at + 1 - length] + score
                if y > x:
                    x, from_ = y, (i, length)
                ended, hits = next(found, (n, None))
            if not single and best[at] + self.missing > x:
                x, from_ = best[at] + self.missing, (-1, 1)
            best[at + 1], back[at + 1] = x, from_
        out, at = [], n
        while at:
            i, length = back[at]
            out.append((i, at - length))
            at -= length
        ids: list[int] = []
        gap = False
        for i, start in reversed(out):
            if i >= 0:
                ids.append(i)
            elif self.fallback:
                ids += [self.bytes[b] for b in text[start].encode("utf-8", "replace")]
            elif not gap:
                ids.append(self.unknown)
            gap = i < 0
        return ids

    def _code(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return segments.joined([self.segment(w.decode("utf-8", "replace").replace(" ", MARK)) for w in found.to_pylist()], np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after another, and how many each has."""
        texts = pc.replace_substring(texts.fill_null(""), MARK, " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise("", texts, " "))
        run, at = segments.flat(texts)
        cuts = np.zeros(len(run), bool)
        cuts[1:] = ~self.inside[run[:-1], run[1:]]
        cuts[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(cuts)
        index, offsets, values = self.memo.of(segments.segments(run, starts))
        ids, lengths = segments.gather(index, offsets, values)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, at)]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """The texts that ids give back, n ids each."""
        run, lengths = segments.gather(ids, *self.back)
        at = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n)])]
        if self.prefix:
            # the space in front goes
            firsts = at[:-1][np.diff(at) > 0]
            gone = firsts[run[firsts] == 32]
            keep = np.ones(len(run), bool)
            keep[gone] = False
            run, at = run[keep], at - np.searchsorted(gone, at)
        found = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(run))])
        try:
            return found.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # malformed runs of byte pieces
            return pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())


def _coder(path: str, decode: bool):
    def run(batches):
        model = PieceModel(path)
        for batch in batches:
            for first, last in segments.slices(batch.column("text")):
                part = batch.slice(first, last - first)
                texts = part.column("text")
                ids, n = model.encode(texts)
                null = texts.is_null()
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                extra = {"piece_ids": pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)), mask=null)}
                if decode:
                    extra["decoded"] = pc.if_else(null, pa.scalar(None, pa.string()), model.decode(ids, n))
                names = [c for c in part.schema.names if c != "text" or not decode]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *extra.values()], [*names, *extra])

    return run


def encode(docs: DataFrame, model_path: str, decode: bool = False) -> DataFrame:
    """docs(text, ...) with piece_ids (array of int); with ``decode`` what the ids give back, decoded, comes in the place of text."""
    docs = docs.drop("piece_ids", *(["decoded"] if decode else []))
    fields = [f for f in docs.schema.fields if f.name != "text" or not decode]
    extra = [StructField("piece_ids", ArrayType(IntegerType())), *([StructField("decoded", StringType())] if decode else [])]
    return docs.mapInArrow(_coder(model_path, decode), StructType([*fields, *extra]))


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as 32-bit little-endian) and exact: whether decoding gave the text back."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_digest(model_path), f"doc_id {dict(docs.dtypes)['doc_id']}, n_pieces long, ids_crc32 long, exact boolean")


def _digest(path: str):
    def run(batches):
        model = PieceModel(path)
        for batch in batches:
            for first, last in segments.slices(batch.column("text")):
                part = batch.slice(first, last - first)
                texts, null = part.column("text"), part.column("text").is_null()
                ids, n = model.encode(texts)
                ends = np.cumsum(n).tolist()
                crc = [zlib.crc32(ids[e - k : e].astype("<i4").tobytes()) for e, k in zip(ends, n.tolist(), strict=True)]
                known = pc.invert(null)
                exact = pc.equal(model.decode(ids, n), texts)
                columns = [pa.array(n.astype(np.int64)), pa.array(crc, pa.int64()), exact]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pc.if_else(known, c, pa.scalar(None, c.type)) for c in columns)], ["doc_id", "n_pieces", "ids_crc32", "exact"])

    return run
