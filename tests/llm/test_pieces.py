import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from siftlake.llm import pieces

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return pieces.PieceModel(MODEL)


def coded(own, texts):
    ids, n = own.encode(pa.array(texts, pa.string()))
    return np.split(ids, np.cumsum(n)[:-1])


def normalized(text):
    return (pieces.MARK + text.replace(" ", pieces.MARK)) if text else ""


def test_pieces_have_the_best_score(spark, own):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    score = {model.id_to_piece(i): model.get_score(i) for i in range(259, model.get_piece_size())}
    lines = [line for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect() for line in r.text.split("\n") if line]
    for line, ids in zip(lines, coded(own, lines), strict=True):
        text, best = normalized(line), [0.0]
        for end in range(1, len(text) + 1):
            arcs = [best[b] + score[text[b:end]] for b in range(max(0, end - 20), end) if text[b:end] in score]
            best.append(max(arcs + ([best[end - 1] + own.missing] if text[end - 1] not in score else [])))
        if (ids > 258).all():
            assert sum(map(model.get_score, ids.tolist())) == pytest.approx(best[-1])
        assert own.decode(ids, np.array([len(ids)])).to_pylist() == [line] == [model.decode(ids.tolist())]


def test_segments_give_the_ids_of_whole_texts(own):
    rng = random.Random(6)
    atoms = ["the", "of", " ", "  ", "\n", ",", ".", "é", "日本", "\U0001f600", "0", "42", "//", "(", "'s", "\t", "x" * 9, "\xa0"]
    texts = ["", "a  b", " a", "日本 ☃ \t x", "a   \n b", *("".join(rng.choice(atoms) for _ in range(rng.randrange(12))) for _ in range(3000))]
    got = coded(own, texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == own.segment(normalized(text)), repr(text)
    n = np.array(list(map(len, got)))
    assert own.decode(np.concatenate(got), n).to_pylist() == texts


def test_marks_and_malformed_bytes(own):
    mark = pieces.MARK
    (ids,) = coded(own, [f"a{mark}b {mark}"])
    assert ids.tolist() == own.segment(normalized(f"a{mark}b {mark}"))
    assert own.decode(ids, np.array([len(ids)])).to_pylist() == ["a b  "]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    half = [own.bytes[0xC3], model.piece_to_id(f"{mark}the")]
    assert own.decode(np.array(half), np.array([2])).to_pylist() == [model.decode(half)] == ["� the"]


def test_round_trip_of_odd_rows(spark, own):
    schema = "doc_id long, text string, piece_ids string, decoded long, n_pieces int"
    long = " ".join("".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(40_000))
    rows = [(1, None, "x", 1, 1), (None, "", "x", 1, 1), (2, "a b", "x", 1, 1), (2, "a b", "x", 1, 1), (3, long, "x", 1, 1), (4, "z" * 30_000, "x", 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = pieces.round_trip(docs, MODEL).collect()
    assert sorted(str(r.exact) for r in got) == ["None", *["True"] * 5] and next(r for r in got if r.exact is None).n_pieces is None
    (ids,) = coded(own, ["a b"])
    assert [r.ids_crc32 for r in got if r.doc_id == 2] == [zlib.crc32(ids.astype("<i4").tobytes())] * 2
    out = pieces.encode(docs, MODEL).collect()
    assert [r.piece_ids for r in out if r.doc_id == 2] == [ids.tolist()] * 2 and out[0].decoded == 1 and out[0].text is None and out[0].piece_ids is None
    back = pieces.encode(docs, MODEL, decode=True)
    assert "text" not in back.columns and {(r.doc_id, r.decoded) for r in back.collect()} == {(r[0], r[1]) for r in rows}
    assert pieces.round_trip(docs.limit(0), MODEL).count() == pieces.encode(docs.limit(0), MODEL).count() == 0
