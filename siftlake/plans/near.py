"""Queries: lookups and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.paths import directory
from siftlake.operators import hash_index as I
from siftlake.operators import matching as M
from siftlake.sources import fixtures as X
from siftlake.sources.shared import cut, new_dir

from .registry import query

FX = X.BASE


def near_pairs(spark: SparkSession, sf_dir: str, find=M.near_dup_multi_index) -> DataFrame:
    """in_id, cat_id and both distances of the incoming rows and the catalogue.

    All texts are read once, for the features and both hashes; searches start from what was written of them.
    """
    features = cut(X.features(spark, sf_dir, X.BOTH).select("doc_id", "hash", "timestamp", "name", "type", "from_path", "ratio", *X.BOTH), "features")
    rows, stored = X.incoming(spark, sf_dir, features=features), X.catalog(spark, sf_dir, features=features)
    pairs = cut(find(rows, stored), "near-pairs")
    return M.second_distance(pairs, rows.select("doc_id", "d_hash"), stored.select("doc_id", "d_hash")).select("in_id", "cat_id", "p_distance", "d_distance")


@query(FX + "SELECT in_id, cat_id, p_distance, d_distance FROM near")
def near_dup_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(spark, sf_dir)


@query(FX + "SELECT in_id, cat_id, p_distance, d_distance FROM near")
def near_dup_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by blocks and one-bit neighbours alone, whatever the ratios."""
    return near_pairs(spark, sf_dir, lambda a, b: M.near_dup_multi_index(a, b, slots=False))


@query(FX + "SELECT in_id, cat_id, p_distance FROM near")
def near_dup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index, made of a catalogue before a run, in which a fifth of the rows was of other states, and kept up to date."""
    now = cut(X.catalog(spark, sf_dir, ("p_hash",)).select("doc_id", "hash", "p_hash", "ratio", "state"), "catalog")
    changed = F.col("doc_id") % 5 == 0
    before = now.withColumn("state", F.when(changed & (F.col("state") >= M.ACCEPTED), 0).when(changed, M.ACCEPTED).otherwise(F.col("state")))
    path = new_dir(spark, "hash-index")
    I.create(before, path)
    I.add(now.filter(changed), path)
    return I.search(cut(X.incoming(spark, sf_dir, ("p_hash",)).select("doc_id", "p_hash", "ratio"), "asked"), path, now)


@query(FX + "SELECT in_id, cat_id, p_distance, d_distance FROM near WHERE p_distance < 3 AND d_distance < 8")
def near_dup_exact_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sure(near_pairs(spark, sf_dir, M.near_dup_sure))


@query(FX + "SELECT *, CAST(row_number() OVER (PARTITION BY in_id ORDER BY p_distance, cat_id) AS INTEGER) AS rank FROM near")
def nearest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ranked(near_pairs(spark, sf_dir))


@query(FX + """SELECT in_id, cat_id, p_distance FROM near JOIN inc n ON n.doc_id = in_id JOIN cat c ON c.doc_id = cat_id
               WHERE regexp_extract(n.from_path, '^(.*)/[^/]*$', 1) <> regexp_extract(c.from_path, '^(.*)/[^/]*$', 1)""")
def exclude_same_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates stored from another directory than the incoming row's."""
    rows = X.incoming(spark, sf_dir).select(F.col("doc_id").alias("in_id"), directory(F.col("from_path")).alias("in_dir"))
    stored = X.catalog(spark, sf_dir).select(F.col("doc_id").alias("cat_id"), directory(F.col("from_path")).alias("cat_dir"))
    pairs = near_pairs(spark, sf_dir).join(rows, "in_id").join(stored, "cat_id")
    return pairs.filter("in_dir <> cat_dir").select("in_id", "cat_id", "p_distance")


@query(FX + "SELECT n.doc_id AS in_id, c.doc_id AS cat_id, c.state FROM inc n JOIN cat c USING (hash)")
def exact_hash_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.exact_lookup(X.incoming(spark, sf_dir), X.catalog(spark, sf_dir)).select("in_id", "cat_id", "state")


@query(FX + """SELECT n.doc_id AS in_id, array_to_string(list_sort(list(c.doc_id)), ',') AS hits FROM inc n JOIN cat c USING (name)
               WHERE NOT (n.name LIKE 'the%') GROUP BY n.doc_id""")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written before labels are looked up, so that no text is shuffled
    features = cut(X.named(X.table(spark, sf_dir, "documents")), "named")
    rows = features.join(X.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return M.name_lookup(rows, X.catalog(spark, sf_dir, features=features), F.col("name").rlike("^the"))


@query(FX + """SELECT n.doc_id AS in_id, max(c.doc_id) AS cat_id FROM inc n
               JOIN cat c ON c.to_path = '/lib/' || n.type || '/' || n.name || '.txt' WHERE c.state >= 200 GROUP BY n.doc_id""")
def imported_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last accepted row stored under the path that the incoming row would get."""
    wanted = X.incoming(spark, sf_dir).select(F.col("doc_id").alias("in_id"), F.concat(F.lit("/lib/"), "type", F.lit("/"), "name", F.lit(".txt")).alias("to_path"))
    return wanted.join(M.accepted(X.catalog(spark, sf_dir)), "to_path").groupBy("in_id").agg(F.max("doc_id").alias("cat_id"))


DONE = "SELECT CAST(user_id AS VARCHAR) AS hash, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views, max(event_id) AS last_id FROM events GROUP BY user_id"


@query(FX + f""", st AS ({DONE})
       SELECT hash, doc_id FROM cat WHERE state >= 200 AND NOT EXISTS
         (SELECT 1 FROM st WHERE CAST(cat.doc_id AS VARCHAR) = st.hash AND ((clicks > 12 AND views > 12) OR last_id % 5 = 2))
       ORDER BY hash LIMIT 100""")
def backlog_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows whose processing isn't done, in order of their hash, a batch of 100."""
    events = X.table(spark, sf_dir, "events")
    state = events.groupBy(F.col("user_id").alias("doc_id")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"), F.max("event_id").alias("last_id"))
    done = state.filter(((F.col("clicks") > 12) & (F.col("views") > 12)) | (F.col("last_id") % 5 == 2))
    return M.accepted(X.catalog(spark, sf_dir)).join(done, "doc_id", "left_anti").select("hash", "doc_id").orderBy("hash").limit(100)


@query(FX + """SELECT DISTINCT c.hash, c.name, c.state, l.quality, CAST(e.n AS BIGINT) AS events, p.p_size AS tag
               FROM cat c JOIN labels l USING (doc_id) JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON e.user_id = c.doc_id
               LEFT JOIN part p ON p.p_partkey = c.doc_id WHERE c.doc_id IN (SELECT user_id FROM events WHERE event_type = 'view')""")
def enrich_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, keys = X.table(spark, sf_dir, "events"), F.col("user_id").alias("doc_id")
    state = events.groupBy(keys).agg(F.count("*").alias("events"))
    asked = events.filter(F.col("event_type") == "view").select(keys).distinct()
    tags = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("tag"))
    rows = X.catalog(spark, sf_dir).join(asked, "doc_id", "left_semi").join(X.table(spark, sf_dir, "labels"), "doc_id").join(state, "doc_id").join(tags, "doc_id", "left")
    return rows.select("hash", "name", "state", "quality", "events", "tag").distinct()


@query(FX + "SELECT doc_id, to_path, to_path IN (SELECT to_path FROM listing) AS present FROM cat")
def existence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.exists(X.catalog(spark, sf_dir), X.listing(spark, sf_dir)).select("doc_id", "to_path", "present")


@query(FX + "SELECT doc_id, hash, CAST(CASE WHEN doc_id % 3 = 0 AND to_path NOT IN (SELECT to_path FROM listing) THEN 2 WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS missing FROM cat")
def mark_missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows counted as present (missing = 0) whose file is gone become missing = 2; others keep their value."""
    rows = X.catalog(spark, sf_dir).withColumn("missing", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1))
    gone = M.exists(rows.filter("missing = 0"), X.listing(spark, sf_dir)).filter("not present").select("doc_id", F.lit(2).alias("now"))
    return rows.join(gone, "doc_id", "left").select("doc_id", "hash", F.coalesce("now", "missing").cast("long").alias("missing"))


@query(FX + "SELECT doc_id, hash FROM cat WHERE doc_id IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def needless_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = X.table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("doc_id"))
    return X.catalog(spark, sf_dir).join(tagged, "doc_id", "left_semi").select("doc_id", "hash")


@query("SELECT event_id, event_type, value FROM events WHERE (event_type, CAST(user_id % 3 AS VARCHAR)) IN (VALUES ('view', '0'), ('click', '1'), ('error', '2'))")
def category_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("view", "0"), ("click", "1"), ("error", "2")], "event_type string, bucket string")
    # the categories are a handful of configured pairs
    rows = X.table(spark, sf_dir, "events").withColumn("bucket", (F.col("user_id") % 3).cast("string"))
    return rows.join(F.broadcast(wanted), ["event_type", "bucket"], "left_semi").select("event_id", "event_type", "value")


@query(FX + """, nr AS (SELECT *, row_number() OVER (PARTITION BY in_id ORDER BY p_distance, cat_id) AS rank FROM near),
       nm AS (SELECT n.doc_id AS in_id, min(c.doc_id) AS cat_id FROM inc n JOIN cat c USING (name) GROUP BY n.doc_id)
       SELECT n.doc_id AS in_id, coalesce(k.cat_id, f.cat_id, nm.cat_id) AS target,
              CASE WHEN k.cat_id IS NOT NULL THEN 'numbered' WHEN f.cat_id IS NOT NULL THEN 'first' WHEN nm.cat_id IS NOT NULL THEN 'name' ELSE 'save' END AS chosen
       FROM inc n LEFT JOIN nr k ON k.in_id = n.doc_id AND k.rank = n.doc_id % 3 LEFT JOIN nr f ON f.in_id = n.doc_id AND f.rank = 1 LEFT JOIN nm ON nm.in_id = n.doc_id""")
def pick_replace_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of the mark's number (here doc_id mod 3), else the first one, else the first of the same name, else none."""
    rows, stored = X.incoming(spark, sf_dir).select("doc_id", "name"), X.catalog(spark, sf_dir)
    near = M.ranked(near_pairs(spark, sf_dir))
    pick = near.groupBy("in_id").agg(F.min_by("cat_id", "rank").alias("first"), F.max(F.when(F.col("rank") == F.col("in_id") % 3, F.col("cat_id"))).alias("numbered"))
    out = rows.select(F.col("doc_id").alias("in_id")).join(pick, "in_id", "left").join(M.name_counts(rows, stored), "in_id", "left")
    chosen = F.when(F.col("numbered").isNotNull(), "numbered").when(F.col("first").isNotNull(), "first").when(F.col("named").isNotNull(), "name").otherwise("save")
    return out.select("in_id", F.coalesce("numbered", "first", "named").alias("target"), chosen.alias("chosen"))


REMOTE = """rem AS (SELECT lower(to_path) AS path, CASE WHEN "timestamp" % 5 = 0 THEN height ELSE width END AS rw,
  CASE WHEN "timestamp" % 5 = 0 THEN width ELSE height END + CASE WHEN "timestamp" % 4 = 1 THEN 1 ELSE 0 END AS rh,
  row_number() OVER (PARTITION BY to_path ORDER BY "timestamp" DESC) AS rn FROM cat WHERE "timestamp" % 3 <> 0)"""


@query(FX + f""", {REMOTE}
       SELECT c.doc_id, CASE WHEN r.path IS NULL THEN 'upload' WHEN (rw = width AND rh = height) OR (rw = height AND rh = width) THEN 'none' ELSE 'override' END AS decision
       FROM cat c LEFT JOIN rem r ON r.path = lower(c.to_path) AND r.rn = 1""")
def backup_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows against a remote listing: the same file has the same dimensions, or swapped ones."""
    return backup_decisions(spark, sf_dir).select("doc_id", "decision")


def backup_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = X.catalog(spark, sf_dir)
    swap = F.col("timestamp") % 5 == 0
    remote = local.filter(F.col("timestamp") % 3 != 0).select(
        F.lower("to_path").alias("path"),
        F.struct("timestamp", F.when(swap, F.col("height")).otherwise(F.col("width")).alias("w"), (F.when(swap, F.col("width")).otherwise(F.col("height")) + F.when(F.col("timestamp") % 4 == 1, 1).otherwise(0)).alias("h")).alias("r"),
    )
    remote = remote.groupBy("path").agg(F.max("r").alias("r"))
    rows = local.withColumn("path", F.lower("to_path")).join(remote, "path", "left")
    same = ((F.col("r.w") == F.col("width")) & (F.col("r.h") == F.col("height"))) | ((F.col("r.w") == F.col("height")) & (F.col("r.h") == F.col("width")))
    return rows.withColumn("decision", F.when(F.col("r").isNull(), "upload").when(same, "none").otherwise("override"))
