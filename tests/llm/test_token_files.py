import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from siftlake.llm import segments, token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")
SPACES = [chr(c) for c in [9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]
ATOMS = ["a", "Ze", "é", "'s", "'ll", "’", "1", "23", "Ж", "я", "ø", ".", ",", "!!", "|", "_", "日", "<|endoftext|>", "xxxxx", "\U0001f600", "İ"]


def test_ids_are_the_librarys_on_random_texts():
    rng = random.Random(4)
    encoder = token_files.Encoder(BPE, 0)
    for at in range(17):
        texts = []
        for _ in range(3000):
            space = rng.choice([SPACES, [" ", "\n"], [" "]])
            texts.append("".join(rng.choice(ATOMS if rng.random() < 0.6 else space) for _ in range(rng.randrange(10))))
        texts += ["a b\n ", " Zé\n ", " '’s\n ", "", "\n\n a", "a \n b \n"]
        if at % 4 == 0:
            encoder = token_files.Encoder(BPE, 0)
        ids, n = encoder.encode(pa.array(texts))
        ends = np.cumsum(n)
        for text, end, length, want in zip(texts, ends, n, encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert ids[end - length : end].tolist() == [*want.ids, 0], text


def test_memo_starts_anew_when_full():
    encoder = token_files.Encoder(BPE, 0)
    encoder.memo.most = 200
    rng = random.Random(5)
    for _ in range(20):
        text = " ".join("".join(rng.choice("abc") for _ in range(3)) for _ in range(40))
        assert encoder.encode(pa.array([text]))[0].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_slices_and_segments():
    texts = pa.array(["abc", None, "", "de", "x" * 50, "y"])
    assert list(segments.slices(texts, 6)) == [(0, 4), (4, 5), (5, 6)]
    run, at = segments.flat(texts.slice(1, 3))
    assert bytes(run) == b"de" and at.tolist() == [0, 0, 0, 2]
    assert list(segments.slices(pa.array([], pa.string()))) == []
    run, _ = segments.flat(pa.array(["a bb  c"]))
    assert segments.segments(run, np.array([0, 2, 6]), np.array([1, 4, 7])).to_pylist() == [b"a", b"bb", b"c"]
    assert segments.segments(run, np.array([], int), np.array([], int)).to_pylist() == []


def test_empty_table_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, part int, file string, ids long")
    assert token_files.read_token_files(token_files.write_token_files(docs, BPE, f"{tmp_path}/a"), BPE, f"{tmp_path}/a").count() == 0
    docs = spark.createDataFrame([(1, "hello world", 5, "f", 9), (None, None, 1, "g", 2), (1, "hello world", 6, "f", 9)], docs.schema)
    got = token_files.read_token_files(token_files.write_token_files(docs, BPE, f"{tmp_path}/b"), BPE, f"{tmp_path}/b").collect()
    crc = zlib.crc32(np.array([*token_files.Encoder(BPE, 0).tokenizer.encode("hello world").ids, 0], "<u4").tobytes())
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in got)[1:] == [(1, 3, crc), (4, 3, crc)]
