"""Queries: sources, merges, classifier gates, user functions, saved SQL and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.hashes import clean_hash_text
from siftlake.functions.reasons import MARK_OF
from siftlake.operators import judging as J
from siftlake.operators import matching as M
from siftlake.operators import merging as G
from siftlake.operators import saved as Q
from siftlake.operators import sequence as S
from siftlake.sources import feature_cache as C
from siftlake.sources import fixtures as X
from siftlake.sources.shared import cut
from siftlake.streaming import ingest as T

from .registry import query
from .verdicts import JUDGED, hashed, judge, judge_each

FX = X.BASE


@query()
def scan_files_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, size and time of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sf_dir).select("path", "length", "modificationTime")


@query(FX + "SELECT doc_id, hash, size, width, height, name, type, from_path, damaged FROM feat")
def collect_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.features(spark, sf_dir).select("doc_id", "hash", "size", "width", "height", "name", "type", "from_path", "damaged")


@query(FX + "SELECT doc_id, hash, size, state, to_path FROM cat")
def scan_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.catalog(spark, sf_dir).select("doc_id", "hash", "size", "state", "to_path")


@query(FX + "SELECT doc_id, hash, state FROM cat WHERE type = 'de'")
def scan_catalog_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One type's rows of a catalogue stored by type: only that partition is read."""
    path = f"{T.work_dir(spark)}/catalog"
    X.catalog(spark, sf_dir).select("doc_id", "hash", "state", "type").write.partitionBy("type").parquet(path)
    return spark.read.parquet(path).filter("type = 'de'").select("doc_id", "hash", "state")


@query(FX + "SELECT c.to_path, replace(c.to_path, '.txt', '.!b.txt') AS marked FROM cat c JOIN labels l USING (doc_id) WHERE l.quality = 1 AND c.to_path IN (SELECT to_path FROM listing)")
def scan_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated rows of a ';' export whose file exists, with their path marked as blocked."""
    path = f"{T.work_dir(spark)}/export"
    X.catalog(spark, sf_dir).join(X.table(spark, sf_dir, "labels"), "doc_id").select(F.col("to_path").alias("Path"), F.col("quality").alias("Rating")).write.option("sep", ";").option("header", True).csv(path)
    rows = spark.read.schema("Path string, Rating string").option("sep", ";").option("header", True).csv(path).filter("Rating = '1'")
    rows = rows.select(F.col("Path").alias("to_path")).join(X.listing(spark, sf_dir), "to_path", "left_semi")
    return rows.select("to_path", F.replace("to_path", F.lit(".txt"), F.lit(".!b.txt")).alias("marked"))


@query(FX + "SELECT hash, doc_id, CASE WHEN doc_id % 13 <> 0 THEN CAST(doc_id * 7 AS VARCHAR) END AS p_hash FROM cat")
def scan_insert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read back from log text: insert lines are decoded, '$' taken off the keys, missing hashes made null."""
    path = f"{T.work_dir(spark)}/log"
    value = F.when(F.col("doc_id") % 13 == 0, "undefined").otherwise((F.col("doc_id") * 7).cast("string"))
    payload = F.to_json(F.struct(F.col("hash").alias("$hash"), F.col("doc_id").alias("$doc_id"), value.alias("$p_hash")))
    X.catalog(spark, sf_dir).select(F.explode(F.array(F.concat(F.lit("INFO insert: row = "), payload), F.lit("DEBUG other line"))).alias("value")).write.text(path)
    lines = spark.read.text(path).filter(F.contains("value", F.lit("insert: row = ")))
    row = F.from_json(F.replace(F.split("value", "insert: row = ")[1], F.lit('"$'), F.lit('"')), "hash string, doc_id long, p_hash string")
    return lines.select(row.alias("r")).select("r.hash", "r.doc_id", clean_hash_text(F.col("r.p_hash")).alias("p_hash"))


@query(FX + """SELECT doc_id, CASE WHEN kind = 'LOCK' THEN 'own' WHEN doc_id % 3 <> 0 OR doc_id % 5 = 0 OR doc_id % 7 > 3 THEN 'computed' WHEN doc_id % 2 = 0 THEN 'filled' ELSE 'cache' END AS origin,
               CASE WHEN kind <> 'LOCK' THEN f.hash END AS hash, CASE WHEN kind <> 'LOCK' THEN md5(text) END AS d_hash, from_path
               FROM (SELECT *, CASE WHEN doc_id % 50 = 23 THEN 'LOCK' ELSE 'IMAGE' END AS kind FROM feat) f JOIN documents USING (doc_id)""")
def feature_cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features read back from JSON, where they are of this version and no older than the file.

    Every third document has a cached row, every fifth of these of another version, and documents of
    remainders 4 to 6 by 7 have changed since; even ones were cached without their second hash, and
    all under another path than they lie at now.
    """
    docs, k = X.table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id")
    later = F.when(k % 7 > 3, F.lit("9999-01-01")).otherwise(F.lit("2000-01-01")).cast("timestamp")
    files = X.features(spark, sf_dir).select(k.cast("string").alias("path"), later.alias("modified"), F.when(k % 50 == 23, "LOCK").otherwise("IMAGE").alias("type"), "from_path")
    of = lambda rows: docs.withColumn("path", k.cast("string")).join(rows.select("path"), "path", "left_semi")
    first = lambda rows: of(rows).select("path", F.sha1("text").alias("hash"), F.md5("text").alias("d_hash"))
    second = lambda rows: of(rows).select("path", F.md5("text").alias("d_hash"))
    folder = f"{T.work_dir(spark)}/cache"
    held = first(files).join(docs.select(k.cast("string").alias("path"), "doc_id"), "path").filter(k % 3 == 0)
    held = held.withColumn("d_hash", F.when(k % 2 == 1, F.col("d_hash"))).withColumn("from_path", F.lit("/elsewhere")).withColumn("type", F.lit("TEXT"))
    for version, rows in (("2", held.filter(k % 5 != 0)), ("1", held.filter(k % 5 == 0))):
        C.write(rows.drop("doc_id"), folder, version)
    cached = C.read(spark, folder, "type string, from_path string, hash string, d_hash string")
    out = C.reuse(files, cached, "2", first, second, F.col("type") == "IMAGE", ["from_path"])
    return out.select(F.col("path").cast("long").alias("doc_id"), "origin", "hash", "d_hash", "from_path")


@query(FX + """SELECT hash, doc_id, state FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY fresh DESC, "timestamp" DESC) AS rn FROM
               (SELECT hash, doc_id, state, "timestamp", 0 AS fresh FROM cat UNION ALL SELECT hash, doc_id, state, "timestamp", 1 FROM inc)) WHERE rn = 1""")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("hash", "doc_id", "state", "timestamp")
    return G.upsert(X.catalog(spark, sf_dir).select(*columns), X.incoming(spark, sf_dir).select(*columns), "hash", "timestamp").drop("timestamp")


@query(FX + "SELECT doc_id, hash IN (SELECT hash FROM cat) AS conflict FROM inc")
def insert_only_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine, conflicts = G.insert_only(X.catalog(spark, sf_dir), X.incoming(spark, sf_dir), "hash")
    return fine.select("doc_id", F.lit(False).alias("conflict")).unionByName(conflicts.select("doc_id", F.lit(True).alias("conflict")))


@query(FX + "SELECT doc_id, hash FROM cat WHERE hash NOT IN (SELECT hash FROM inc)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.delete(X.catalog(spark, sf_dir), X.incoming(spark, sf_dir), "hash").select("doc_id", "hash")


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) AS size FROM conversations),
          n AS (SELECT conv_id, turn, max(struct_pack(s := size, r := role)) AS x FROM c GROUP BY conv_id, turn)
          SELECT conv_id, turn, x.r AS role, CAST(x.s AS BIGINT) AS size FROM n UNION ALL SELECT DISTINCT conv_id, -1, 'stored', CAST(0 AS BIGINT) FROM c""")
def child_insert_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested children, one row each, merged into a child table under a key of two columns.

    The table holds a first child of every conversation, and a row -1 that no new child touches; of
    several new children of a key the largest is written last.
    """
    rows = X.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.length("text").cast("long").alias("size"))
    nested = rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "size")).alias("children"))
    new = nested.select("conv_id", F.inline("children")).withColumn("seq", F.struct("size", "role"))
    held = nested.select("conv_id", F.explode(F.array(F.lit(-1).cast("long"), F.get("children", F.lit(0))["turn"])).alias("turn"))
    stored = held.select("conv_id", "turn", F.lit("stored").alias("role"), F.lit(0).cast("long").alias("size"), F.lit(None).cast(dict(new.dtypes)["seq"]).alias("seq"))
    return G.upsert(stored, new, ["conv_id", "turn"], "seq").drop("seq")


@query("SELECT doc_id, CASE WHEN quality > 0 THEN true ELSE false END AS accept_allow, NOT (quality > 0) AS accept_disallow FROM labels")
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = F.col("quality") > 0
    return X.table(spark, sf_dir, "labels").select("doc_id", over.alias("accept_allow"), (~over).alias("accept_disallow"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND value > 20) > 0 AS accept FROM events GROUP BY user_id")
def count_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if((F.col("event_type") == "error") & (F.col("value") > 20)) > 0).alias("accept"))


@query("SELECT doc_id, CASE WHEN lang <> 'en' THEN true ELSE quality = 1 AND toxic = 0 END AS accept_and, CASE WHEN lang <> 'en' THEN true WHEN quality = 1 OR doc_id % 5 = 0 THEN quality = 1 ELSE toxic = 0 END AS accept_or FROM labels JOIN documents USING (doc_id)")
def combine_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two gates joined: other types pass; 'and' needs both; 'or' gives the first gate's value if it or the later judge (every fifth row) accepts, else the second's."""
    rows = X.table(spark, sf_dir, "labels").join(X.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    first, second, later, other = F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 5 == 0, F.col("lang") != "en"
    return rows.select("doc_id", F.when(other, True).otherwise(first & second).alias("accept_and"), F.when(other, True).when(first | later, first).otherwise(second).alias("accept_or"))


def scored_batches(rows: DataFrame, load, version: int) -> DataFrame:
    """doc_id, score, state (2 scored, 1 failed), version of rows(doc_id, text).

    load() gives a scorer once a task: a function from a series of texts to their scores. A batch that
    it can't score is halved until the rows that fail are alone; a score that is no number fails too.
    """

    def run(batches):
        score = load()

        def scores(texts: pd.Series) -> list:
            try:
                found = list(score(texts))
                if len(found) != len(texts):
                    raise ValueError("a score for each text")
                return found
            except Exception:  # a model may fail in any way; its row is marked as failed
                half = len(texts) // 2
                return scores(texts[:half]) + scores(texts[half:]) if half else [None] * len(texts)

        for pdf in batches:
            found = pd.to_numeric(pd.Series(scores(pdf["text"].reset_index(drop=True)), dtype="object"), errors="coerce").astype("float64")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": found.to_numpy(), "state": found.notna().map({True: 2, False: 1}).to_numpy(), "version": version})

    out = rows.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, state int, version int")
    return out.withColumn("score", F.when(F.col("state") == 2, F.col("score")))


def vowel_share():
    """A stand-in model: the share of vowels; no text and empty ones have none."""
    return lambda texts: texts.str.lower().str.count("[aeiou]") / texts.str.len().replace(0, float("nan"))


SHARE = "CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(lower(text), '[aeiou]', '', 'g'))) / length(text) END"


def scored(rows: DataFrame, stored: DataFrame, load, version: int) -> DataFrame:
    """Scores of rows(doc_id, text): those stored with this version or a newer one are used again, all others go to the model."""
    valid = stored.join(rows.select("doc_id"), "doc_id", "left_semi").filter((F.col("version") >= version) & (F.col("state") == 2))
    return valid.unionByName(scored_batches(rows.join(valid, "doc_id", "left_anti"), load, version))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN 0.25 ELSE {SHARE} END AS score, CAST(CASE WHEN doc_id % 12 = 0 OR length(text) > 0 THEN 2 ELSE 1 END AS INTEGER) AS state,
           CAST(CASE WHEN doc_id % 12 = 0 THEN 3 ELSE 2 END AS INTEGER) AS version FROM documents""")
def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth row has a stored score: of version 3 (every twelfth), of the older version 1, or failed; only the first are used again."""
    docs, k = X.table(spark, sf_dir, "documents"), F.col("doc_id")
    stored = docs.filter(k % 4 == 0).select("doc_id", F.lit(0.25).alias("score"), F.when(k % 12 == 4, 1).otherwise(2).alias("state"), F.when(k % 12 == 8, 1).otherwise(3).alias("version"))
    return scored(docs, stored, vowel_share, 2)


@query(FX + f"""SELECT doc_id, {SHARE} AS score, CAST(CASE WHEN length(text) > 0 THEN 2 ELSE 1 END AS INTEGER) AS state, CAST(1 AS INTEGER) AS version, CASE WHEN {SHARE} < 0.3 THEN 'block' END AS mark
                FROM documents WHERE doc_id IN (SELECT doc_id FROM cat WHERE state >= 200) AND doc_id NOT IN (SELECT user_id FROM events)""")
def backfill_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows without a score are scored and judged; rejected ones get the mark of the classifier's reason."""
    wanted = M.accepted(X.catalog(spark, sf_dir)).select("doc_id")
    known = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    rows = X.table(spark, sf_dir, "documents").join(wanted, "doc_id", "left_semi").join(known, "doc_id", "left_anti")
    return scored_batches(rows, vowel_share, 1).withColumn("mark", F.when(F.col("score") < 0.3, MARK_OF["TYPE_DEEP_LEARNING"]))


#: A user's functions: from columns to a column.
HOOKS = {"judge": lambda r: r["quality"] == 1, "post_judge": lambda r: r["toxic"] == 0, "skip": lambda r: r["doc_id"] % 10 == 0, "sort_mark": lambda r: F.lpad((r["doc_id"] % 100).cast("string"), 3, "0")}


@query("SELECT doc_id, quality = 1 AS judge, toxic = 0 AS post_judge, doc_id % 10 = 0 AS skip, lpad(CAST(doc_id % 100 AS VARCHAR), 3, '0') AS sort_mark FROM labels")
def user_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "labels")
    return rows.select("doc_id", *[f(rows).alias(n) for n, f in HOOKS.items()])


SAVED = "SELECT type, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM {catalog} WHERE state >= 200 GROUP BY type"


@query(FX + SAVED.format(catalog="cat"))
def saved_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are put, posted, put again under the same id and deleted; the one that is left of its name is run."""
    saved = Q.put(spark.createDataFrame([("1", "other", "SELECT 1")], Q.SCHEMA), "2", "sizes", "SELECT 1 AS n")
    saved, posted = Q.post(saved, "sizes", "SELECT 2 AS n")
    saved, _ = Q.delete(Q.put(saved, "2", "sizes", SAVED), posted)
    return Q.run(saved, "sizes", catalog=X.catalog(spark, sf_dir))


@query(JUDGED + "SELECT * FROM jd")
def stream_ingest_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged as their files arrive: features, searches and the cascade run over the batch alone; the verdicts are those of one batch."""

    stored = cut(X.catalog(spark, sf_dir, X.BOTH), "catalog")

    def judged(rows: DataFrame, earlier: DataFrame | None):
        return judge(spark, sf_dir, rows, stored, earlier), lambda verdicts: J.left_by(verdicts, rows)

    mutate = lambda rows, verdicts: J.mutations(verdicts, rows, stored)
    return T.judged_stream(spark, X.waiting(spark, sf_dir), "doc_id", lambda docs: X.incoming_of(docs, X.BOTH), judged, mutate)


def applied(spark: SparkSession, sf_dir: str, files: int = 3) -> tuple[DataFrame, DataFrame]:
    """Verdicts and last catalogue of a stream of documents that are judged and applied batch by batch."""
    first = cut(X.catalog(spark, sf_dir, X.BOTH), "catalog")
    listing = cut(X.listing_of(first), "listing")

    def step(docs: DataFrame, stored: DataFrame):
        rows = hashed(docs)
        verdicts = judge_each(spark, sf_dir, rows, stored, listing)
        return verdicts, S.next_snapshot(verdicts, rows, stored)

    return T.applied_stream(spark, X.waiting(spark, sf_dir), "doc_id", first, step, files)


@query()
def stream_ingest_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after documents have arrived in files: each batch is judged row after row against the last version, by hash, near hash and name, and written as the next one. The catalogue is hashed once; what comes is hashed as it comes."""
    return applied(spark, sf_dir)[1].select("hash", "doc_id", "state", "to_path")


@query("SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY user_id, event_type")
def stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return T.first_seen(spark, rows, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type", F.lit(True).alias("seen"))


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 300 AS BIGINT) AS batch FROM events WHERE event_type = 'error'")
def stream_backlog_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.drained(spark, X.table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id"), 300, "event_id")


@query("WITH " + X.PATCHES + " SELECT hash, max(view_date) AS view_date, arg_max(rating, event_id) FILTER (WHERE rating IS NOT NULL) AS rating FROM pt GROUP BY hash")
def stream_state_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.patched_table(spark, X.patches(spark, sf_dir).select("hash", "event_id", "view_date", "rating"), "hash", "event_id", ["view_date", "rating"])
