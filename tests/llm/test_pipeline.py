import pyarrow as pa

import corpus_pipeline as C
from siftlake.llm import common, order_minhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    junk = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", "en", None, 5)], docs.schema)
    docs, kept = docs.union(junk), []
    for name, stage in C.STAGES:
        docs = common.cut(stage(spark, docs, SF), "stage")
        kept.append((name, docs))
    assert all(d.columns == columns for _, d in kept[:-1]) and kept[-1][1].columns == [*columns, "piece_ids"]
    counts = [d.count() for _, d in kept]
    assert kept[0][1].filter("doc_id > 9000").count() == 0 and counts[0] >= 198
    classes = order_minhash.near_duplicates(kept[1][1])
    assert classes.filter("class_id <> doc_id").count() == 0 and counts[2] == counts[1]
    assert kept[2][1].filter("text like '%@mail%.example.com%'").count() == 0
    assert kept[4][1].filter("piece_ids is null").count() == 0


def test_language_id_rejects_gibberish(spark):
    import random

    sf = "/root/testdata/sf0.01"
    docs, rng = spark.read.parquet(f"{sf}/documents.parquet"), random.Random(1)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (3, 12, 40, 200)]
    mixed = " ".join(r.text[:150] for r in docs.filter("n_chars > 300").orderBy("lang", "doc_id").dropDuplicates(["lang"]).collect())
    clean = ["Von.", "That it.", "Des enberge die enver.", "Pachque çaneux et."]
    rows = [(9_000_001 + i, t, "en", "s", len(t)) for i, t in enumerate([*junk, "xqzvw kjhgt zzxqj wvxkq", mixed, *clean])]
    kept = C.language_id(spark, docs.union(spark.createDataFrame(rows, docs.schema)), sf)
    assert sorted(r.doc_id for r in kept.filter("doc_id > 9000000").collect()) == [9_000_007 + i for i in range(4)]
    assert kept.filter("doc_id < 9000000").count() >= 0.999 * docs.filter("text rlike '[a-zA-Z]'").count()


def test_piece_ids_are_decoded(spark, monkeypatch):
    from siftlake.llm import pieces

    docs = spark.createDataFrame([(1, "a  b 日本 ☃ \t x", "en", "s", 13), (2, None, "en", "s", 0), (3, "The other.", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in C.piece_ids(spark, docs, SF).collect()}
    model = pieces.PieceModel(C.public_tokenizers.path("piece_bpe_32k.model"))
    assert all(got[r.doc_id].text == r.text for r in docs.collect()) and got[3].piece_ids == model.encode(pa.array(["The other."]))[0].tolist()
    seen, coder = [], pieces._coder
    monkeypatch.setattr(pieces, "_coder", lambda path, decode: seen.append(decode) or coder(path, decode))
    C.piece_ids(spark, docs, SF)
    assert seen == [True]


def test_near_dedup_of_repeated_rows_and_null_ids(spark):
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " twelve", "en", "s", 1), (None, text, "en", "s", 1), (None, "other words stand here alone", "en", None, 2), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = C.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, text), (None, rows[4][1]), (3, None), (4, "")], key=str)
    assert C.near_dedup(spark, docs.limit(0), SF).count() == 0
