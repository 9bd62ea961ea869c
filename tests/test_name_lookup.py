"""Rows of one name, and the first words that names are made of."""

from collections import defaultdict

from pyspark.sql import functions as F

from siftlake.functions import hashes as H
from siftlake.operators import matching as M


def test_hits_of_a_hot_name_are_dealt_and_written_once_a_name(spark, monkeypatch):
    monkeypatch.setattr(M, "HITS_A_PART", 3, raising=False)
    monkeypatch.setattr(M, "MOST_PARTS", 4, raising=False)
    name = lambda i: ["hot", "cold", f"n{i}", "the one", None][0 if i % 3 else i % 5]
    stored, rows = [(i, name(i)) for i in range(60)], [(100 + i, name(i)) for i in range(90)]
    table = lambda t: spark.createDataFrame(t, "doc_id long, name string")
    got = M.name_lookup(table(rows), table(stored), F.col("name").rlike("^the"))
    of = defaultdict(list)
    for i, n in stored:
        of[n].append(str(i))
    want = {i: ",".join(of[n]) for i, n in rows if n and not n.startswith("the") and n in of}
    assert len(of["hot"]) > 3 * 4 and {r.in_id: r.hits for r in got.collect()} == want and got.count() == len(want)
    assert "transform" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_words_are_those_of_all_words(spark):
    texts = ["", " ", "a", "a b", "a b c", "a b c d e", " a b c d", "--a--b--c--", "A_b,Ç.D e", "..x", "İx ΑΣ'Α ß q r", "\n\na\tb c d", None]
    # words and gaps that go beyond the start of a text
    texts += [f"{a}{b}{c}" for a in ("", "a b ", "a b c", "a b c d") for b in ("x" * 399, " " * 400, "ü" * 400, "-" * 1000) for c in ("", " q", "Q r s t u")]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select(H.first_words(F.col("text"), 3).alias("a"), F.slice(H.tokens(F.col("text")), 1, 3).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[5].a == ["a", "b", "c"]
