"""Views of the given tables that stand for the parts of a catalogue: features, catalog, incoming, ..."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions.hashes import character_statistics, content_digest, first_words, majority_hashes, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SALTS = {"p_hash": "", "d_hash": "d|"}
BOTH = tuple(SALTS)


def similarity_hashes(docs: DataFrame, names: tuple[str, ...] = ("p_hash", "d_hash")) -> DataFrame:
    """doc_id and similarity hashes of docs(doc_id, text) with words; each row by itself."""
    found = majority_hashes({n: SALTS[n] for n in names})(F.array_distinct(tokens(F.col("text"))))
    return docs.select("doc_id", found.alias("h")).select("doc_id", "h.*").filter(F.col(names[0]).isNotNull())


def features_of(docs: DataFrame, hashes: tuple[str, ...] = ()) -> DataFrame:
    """One feature row a document; with ``hashes``, also these (null without words) and the content's ``statistics``, from the same words of the text."""
    docs = docs.withColumn("w", tokens(F.col("text")))
    name = F.concat_ws(" ", F.slice("w", 1, 3))
    width = F.size("w").cast("long")
    own = [
        "doc_id",
        content_digest(F.col("text")).alias("hash"),
        F.col("n_chars").cast("long").alias("size"),
        width.alias("width"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("height"),
        F.when(width > 0, F.col("n_chars") / width).otherwise(0.0).alias("ratio"),
        F.col("doc_id").alias("timestamp"),
        name.alias("name"),
        F.col("lang").alias("type"),
        "source",
        F.concat(F.lit("/in/"), "source", F.lit("/"), "lang", F.lit("/"), name, F.lit(".txt")).alias("from_path"),
        (F.col("n_chars") < 20).alias("damaged"),
    ]
    if not hashes:
        return docs.select(*own)
    # all that looks at the words comes first, as rows are held with all their columns while Python has them
    rows = docs.select(*own, "text", F.array_distinct("w").alias("u"))
    found = rows.withColumn("h", majority_hashes({n: SALTS[n] for n in hashes})(F.col("u"))).withColumn("s", character_statistics()(F.col("text")))
    # the distinct words are looked at twice, else the planner would put what makes them, and with it the words, behind
    known = [F.when(F.size("u") > 0, F.col("h")[n]).alias(n) for n in hashes]
    variety = F.when(F.col("width") > 0, F.size("u") * 100.0 / F.col("width")).otherwise(0.0)
    statistics = F.when(F.length("text") > 0, F.struct("s.mean", "s.entropy", variety.alias("quality")))
    return found.select(*[c for c in rows.columns if c not in ("text", "u")], *known, statistics.alias("statistics"))


def named(docs: DataFrame) -> DataFrame:
    """What feature rows hold without looking at all words of a text."""
    name = F.concat_ws(" ", first_words(F.col("text"), 3))
    return docs.select("doc_id", content_digest(F.col("text")).alias("hash"), F.col("doc_id").alias("timestamp"), name.alias("name"), F.col("lang").alias("type"))


def _variety():
    """Type-token ratio (percent) of words ``w``, of which ``u`` are distinct."""
    return F.when(F.size("w") > 0, F.size("u") * 100.0 / F.size("w")).otherwise(0.0)


def features(spark: SparkSession, sf_dir: str, hashes: tuple[str, ...] = ()) -> DataFrame:
    """One feature row a document; similarity hashes and statistics only where asked for."""
    return features_of(table(spark, sf_dir, "documents"), hashes)


def catalog(spark: SparkSession, sf_dir: str, hashes: tuple[str, ...] = (), features: DataFrame | None = None) -> DataFrame:
    """Stored rows: labelled documents (those of ``features``, where given), the last one of each hash, with state and library path."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_quality"), "toxic")
    rows = features_of(table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi"), hashes) if features is None else features
    rows = rows.join(labels, "doc_id")
    state = F.when(F.col("toxic") == 1, 0).when(F.col("label_quality") == 0, 100).when(F.col("doc_id") % 10 == 0, 300).otherwise(200)
    rows = rows.withColumn("state", state.cast("long")).withColumn("to_path", F.concat(F.lit("/lib/"), "type", F.lit("/"), "name", F.lit(".txt")))
    last = Window.partitionBy("hash").orderBy(F.desc("timestamp"))
    return rows.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn", "label_quality", "toxic")


#: Name marks and kinds of incoming rows, by the remainder of their id.
PATH_MARKS = {7: ".!h", 8: ".!b", 9: ".!d", 10: ".!e", 11: ".!r", 12: ".!r2", 13: ".!t", 14: ".!s", 15: ".!hs"}
ODD_KINDS = {20: "UNKNOWN", 21: "SCRAP", 22: "CACHE", 23: "LOCK"}


def _by_remainder(n: int, values: dict[int, str], other: str):
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col("doc_id") % n == k, v).otherwise(out)
    return out


def waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def incoming_of(docs: DataFrame, hashes: tuple[str, ...] = ()) -> DataFrame:
    """Rows to be judged, of documents."""
    return arriving(features_of(docs, hashes))


def arriving(rows: DataFrame) -> DataFrame:
    """Rows to be judged, of feature rows: some have marks in their names, some are no texts, some lie in the library."""
    path = F.when(F.col("doc_id") % 120 == 8, F.concat(F.lit("/lib/"), F.substr("from_path", F.lit(5)))).otherwise(F.col("from_path"))
    path = F.concat(F.substr(path, F.lit(1), F.length(path) - 4), _by_remainder(60, PATH_MARKS, ""), F.lit(".txt"))
    return rows.withColumn("state", F.when(F.col("doc_id") % 11 == 0, 300).otherwise(200).cast("long")).withColumn("from_path", path).withColumn("kind", _by_remainder(50, ODD_KINDS, "TEXT"))


def incoming(spark: SparkSession, sf_dir: str, hashes: tuple[str, ...] = (), features: DataFrame | None = None) -> DataFrame:
    """Documents (those of ``features``, where given) without a label, waiting to be judged."""
    if features is None:
        return incoming_of(waiting(spark, sf_dir), hashes)
    return arriving(features.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library paths that exist."""
    return listing_of(catalog(spark, sf_dir))


def listing_of(stored: DataFrame) -> DataFrame:
    """The same of the catalogue's rows."""
    return stored.filter(F.col("timestamp") % 7 != 0).select("to_path").distinct()


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mean code point, entropy of characters and type-token ratio (percent) of each document with characters."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    docs = docs.select("doc_id", character_statistics()(F.col("text")).alias("s"), tokens(F.col("text")).alias("w")).withColumn("u", F.array_distinct("w"))
    return docs.select("doc_id", "s.mean", "s.entropy", _variety().alias("quality"))


def statistics_of(*rows: DataFrame) -> DataFrame:
    """The same of feature rows with ``statistics``."""
    found = [r.filter(F.col("statistics").isNotNull()).select("doc_id", "statistics.*") for r in rows]
    return functools.reduce(DataFrame.unionByName, found)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores in long form: the share of each event type among a user's events."""
    events = table(spark, sf_dir, "events")
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    totals = events.groupBy("user_id").agg(F.count("*").alias("total"))
    return counts.join(totals, "user_id").select(F.col("user_id").cast("string").alias("hash"), F.col("event_type").alias("class_name"), (F.col("n") / F.col("total")).alias("probability"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State updates from events: view counts and dates from views, ratings from others."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("user_id").cast("string").alias("hash"),
        "event_id",
        F.when(F.col("event_type") == "view", F.col("event_id")).alias("view_date"),
        F.when(F.col("event_type") == "click", k % 6).alias("rating"),
        k.alias("k"),
        "event_type",
    )


def _bits(hashes: str) -> str:
    """SQL of a similarity hash: a bit for every column of word hashes that more than half of the words have set."""
    return " + ".join(f"(CASE WHEN sum(({hashes} >> {i}) & 1) * 2 > any_value(n) THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(64))


#: The same views for DuckDB.
BASE = r"""
WITH tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
feat AS (
  SELECT d.doc_id, sha1(d.text) AS hash, CAST(n_chars AS BIGINT) AS size, CAST(len(w) AS BIGINT) AS width,
         CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS height,
         CASE WHEN len(w) > 0 THEN CAST(n_chars AS DOUBLE) / len(w) ELSE 0 END AS ratio,
         d.doc_id AS "timestamp", array_to_string(w[1:3], ' ') AS name, lang AS type, source,
         '/in/' || source || '/' || lang || '/' || array_to_string(w[1:3], ' ') || '.txt' AS from_path, n_chars < 20 AS damaged
  FROM documents d JOIN tok USING (doc_id)),
cat AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT f.*, CAST(CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 100 WHEN f.doc_id % 10 = 0 THEN 300 ELSE 200 END AS BIGINT) AS state,
           '/lib/' || type || '/' || name || '.txt' AS to_path, row_number() OVER (PARTITION BY hash ORDER BY "timestamp" DESC) AS rn
    FROM feat f JOIN labels USING (doc_id)) WHERE rn = 1),
inc AS (
  SELECT f.* EXCLUDE (from_path), CAST(CASE WHEN doc_id % 11 = 0 THEN 300 ELSE 200 END AS BIGINT) AS state,
         CASE WHEN doc_id % 120 = 8 THEN '/lib/' || substr(from_path, 5, length(from_path) - 8) ELSE substr(from_path, 1, length(from_path) - 4) END ||
         CASE doc_id % 60 WHEN 7 THEN '.!h' WHEN 8 THEN '.!b' WHEN 9 THEN '.!d' WHEN 10 THEN '.!e' WHEN 11 THEN '.!r' WHEN 12 THEN '.!r2' WHEN 13 THEN '.!t' WHEN 14 THEN '.!s' WHEN 15 THEN '.!hs' ELSE '' END || '.txt' AS from_path,
         CASE doc_id % 50 WHEN 20 THEN 'UNKNOWN' WHEN 21 THEN 'SCRAP' WHEN 22 THEN 'CACHE' WHEN 23 THEN 'LOCK' ELSE 'TEXT' END AS kind
  FROM feat f WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
listing AS (SELECT DISTINCT to_path FROM cat WHERE "timestamp" % 7 <> 0),
wh AS (
  SELECT doc_id, ('0x' || substr(md5(x), 1, 16))::UBIGINT AS p, ('0x' || substr(md5('d|' || x), 1, 16))::UBIGINT AS d, n
  FROM (SELECT doc_id, unnest(list_distinct(w)) AS x, len(list_distinct(w)) AS n FROM tok)),
sim AS MATERIALIZED (
  SELECT doc_id, CAST(""" + _bits("p") + """ AS UBIGINT) AS p, CAST(""" + _bits("d") + """ AS UBIGINT) AS d FROM wh GROUP BY doc_id),
acc AS (SELECT c.*, s.p, s.d FROM cat c LEFT JOIN sim s USING (doc_id) WHERE state >= 200),
incs AS (SELECT n.*, s.p, s.d FROM inc n LEFT JOIN sim s USING (doc_id)),
near AS MATERIALIZED (
  SELECT n.doc_id AS in_id, c.doc_id AS cat_id, CAST(bit_count(xor(n.p, c.p)) AS INTEGER) AS p_distance,
         CAST(bit_count(xor(n.d, c.d)) AS INTEGER) AS d_distance
  FROM incs n JOIN acc c ON c.ratio BETWEEN n.ratio - 0.2 AND n.ratio + 0.2 AND bit_count(xor(n.p, c.p)) < 11)
"""

SCORES = """
sc AS (SELECT CAST(user_id AS VARCHAR) AS hash, event_type AS class_name, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS probability
       FROM events GROUP BY user_id, event_type)
"""

PATCHES = """
pt AS (SELECT CAST(user_id AS VARCHAR) AS hash, event_id, CASE WHEN event_type = 'view' THEN event_id END AS view_date,
              CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 END AS rating,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events)
"""
