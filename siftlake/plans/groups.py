"""Queries: aggregation, ranking, order and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.numbers import half_up
from siftlake.functions.paths import lookup
from siftlake.operators import matching as M
from siftlake.operators.naming import without_collisions
from siftlake.sources import fixtures as X

from .near import near_pairs
from .registry import query

FX, SC, PT = X.BASE, "WITH " + X.SCORES, "WITH " + X.PATCHES
CLASSES = ["view", "click", "purchase", "signup", "error"]
R3 = lambda x: f"floor(({x}) * 1000 + 0.5) / 1000"
#: Sums of rounded scores, rounded again.
SUMS = {"active": ["click", "purchase"], "passive": ["view", "signup"], "buyer": ["purchase", "signup"], "all_but_error": ["view", "click", "purchase", "signup"]}


@query(SC + ", w AS (SELECT hash, " + ", ".join(f"coalesce({R3(f'max(CASE WHEN class_name = {chr(39)}{c}{chr(39)} THEN probability END)')}, -1) AS {c}" for c in CLASSES) + " FROM sc GROUP BY hash) SELECT *, " + ", ".join(f"{R3(' + '.join(f'greatest({c}, 0)' for c in cs))} AS {n}" for n, cs in SUMS.items()) + " FROM w")
def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores to a row a key: each rounded to three places, -1 where absent, then sums of the rounded ones."""
    wide = X.scores(spark, sf_dir).groupBy("hash").pivot("class_name", CLASSES).agg(F.max("probability"))
    wide = wide.select("hash", *[F.coalesce(half_up(F.col(c), 3), F.lit(-1.0)).alias(c) for c in CLASSES])
    total = lambda cs: sum((F.greatest(c, F.lit(0.0)) for c in cs[1:]), F.greatest(cs[0], F.lit(0.0)))
    return wide.select("*", *[half_up(total(cs), 3).alias(n) for n, cs in SUMS.items()])


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one row with an array of turns."""
    turns = X.table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("size"), F.sha1("text").alias("token")))).alias("turns"))


@query("SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS size, sha1(text) AS token FROM conversations")
def explode_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(spark, sf_dir).select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.turn", "t.role", "t.size", "t.token")


@query("SELECT conv_id, count(*) AS children, string_agg(role || ':' || CAST(length(text) AS VARCHAR), ';' ORDER BY turn, role, length(text)) AS turns FROM conversations GROUP BY conv_id")
def regroup_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explode_children(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "size"))).alias("t"))
    return rows.select("conv_id", F.size("t").cast("long").alias("children"), F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(":"), x["size"])), ";").alias("turns"))


@query("SELECT conv_id, count(*) AS face_num FROM conversations GROUP BY conv_id")
def child_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("face_num"))


@query(SC + " SELECT hash, round(coalesce(sum(probability) FILTER (WHERE class_name IN ('error', 'signup')), 0), 9) AS total, coalesce(sum(probability) FILTER (WHERE class_name IN ('error', 'signup')), 0) < 0.4000000001 AS accept FROM sc GROUP BY hash")
def score_sum_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.coalesce(F.sum(F.when(F.col("class_name").isin("error", "signup"), F.col("probability"))), F.lit(0.0))
    return X.scores(spark, sf_dir).groupBy("hash").agg(F.round(total, 9).alias("total"), (total < 0.4000000001).alias("accept"))


@query("SELECT conv_id, bool_or(length(text) > 400) AS hit, bool_or(length(text) > 400) AS accept_allow, NOT bool_or(length(text) > 400) AS accept_disallow, true AS accept_quirk FROM conversations GROUP BY conv_id")
def any_child_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any child satisfies the predicate, and what the modes make of it.

    In the quirk variant of the disallow mode a hit is not looked at, so it always accepts;
    the default fixes that.
    """
    hit = F.bool_or(F.length("text") > 400)
    return X.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(hit.alias("hit"), hit.alias("accept_allow"), (~hit).alias("accept_disallow"), F.lit(True).alias("accept_quirk"))


@query("SELECT c_custkey, coalesce(n, 0) > 0 AND coalesce(low, 0) >= 10 AS valid FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS low FROM events WHERE event_type = 'click' GROUP BY user_id) ON user_id = c_custkey")
def all_version_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a key has rows and none of an older version than 10."""
    low = X.table(spark, sf_dir, "events").filter("event_type = 'click'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.min(F.get_json_object("props", "$.k").cast("long")).alias("low"))
    return X.table(spark, sf_dir, "customer").join(low, "c_custkey", "left").select("c_custkey", F.coalesce(F.col("low") >= 10, F.lit(False)).alias("valid"))


@query(PT + " SELECT hash, string_agg(CAST(k AS VARCHAR), ',' ORDER BY event_id) AS log FROM pt GROUP BY hash")
def group_log_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of each key in log order."""
    rows = X.patches(spark, sf_dir).groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("event_id", "k"))).alias("l"))
    return rows.select("hash", F.array_join(F.transform("l", lambda x: x["k"].cast("string")), ",").alias("log"))


@query(PT + " SELECT hash, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN v END AS value FROM (SELECT hash, arg_min(p, event_id) AS v FROM (SELECT hash, event_id, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN CAST(k AS VARCHAR) ELSE event_type END AS p FROM pt) WHERE p <> '' GROUP BY hash)")
def first_valid_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value in log order that isn't empty, used only if all digits."""
    k = F.col("k")
    value = F.when(k % 3 == 0, "").when(k % 3 == 1, k.cast("string")).otherwise(F.col("event_type"))
    rows = X.patches(spark, sf_dir).withColumn("p", value).filter("p <> ''").groupBy("hash").agg(F.min_by("p", "event_id").alias("v"))
    return rows.select("hash", F.when(F.col("v").rlike("^[0-9]+$"), F.col("v")).alias("value"))


@query("SELECT event_type AS reason, count(*) AS n, CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS corrected FROM events WHERE event_type <> 'signup' GROUP BY event_type")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "events").filter("event_type <> 'signup'")
    return rows.groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("corrected"))


@query("SELECT DISTINCT role FROM conversations")
def distinct_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "conversations").select("role").distinct()


@query("SELECT sha1(text) AS hash, count(*) AS copies, max(doc_id) AS survivor FROM documents GROUP BY sha1(text)")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of exact copies: how many, and the last one, which a keyed table would keep."""
    return X.table(spark, sf_dir, "documents").groupBy(F.sha1("text").alias("hash")).agg(F.count("*").alias("copies"), F.max("doc_id").alias("survivor"))


@query(FX + """SELECT in_id, cat_id, CAST(row_number() OVER (PARTITION BY in_id ORDER BY p_distance, cat_id) AS INTEGER) AS number
               FROM near JOIN cat ON cat.doc_id = cat_id WHERE to_path IN (SELECT to_path FROM listing)""")
def number_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from 1 of the candidates that have a file to show."""
    there = M.exists(X.catalog(spark, sf_dir), X.listing(spark, sf_dir)).filter("present").select(F.col("doc_id").alias("cat_id"))
    return M.ranked(near_pairs(spark, sf_dir).join(there, "cat_id", "left_semi")).select("in_id", "cat_id", F.col("rank").alias("number"))


def first_of(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Of ordered candidate verdicts: the first delete, else the first replacement or transfer, else a hold; a save is never chosen."""
    pick = lambda *actions: F.min_by(F.struct("action", "cat_id"), F.when(F.col("action").isin(*actions), F.col(rank)))
    chosen = rows.groupBy(key).agg(pick("delete").alias("d"), pick("replace", "transfer").alias("r"))
    return chosen.select(key, F.coalesce("d.action", "r.action", F.lit("hold")).alias("action"), F.coalesce("d.cat_id", "r.cat_id").alias("cat_id"))


@query("""WITH v AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'replace' WHEN 'signup' THEN 'transfer' WHEN 'view' THEN 'save' ELSE 'hold' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rank FROM events),
          p AS (SELECT user_id, min(CASE WHEN action = 'delete' THEN rank END) AS d, min(CASE WHEN action IN ('replace', 'transfer') THEN rank END) AS r FROM v GROUP BY user_id)
          SELECT p.user_id, coalesce(v.action, 'hold') AS action, v.event_id AS cat_id FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.rank = coalesce(p.d, p.r)""")
def first_delete_else_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = {"error": "delete", "purchase": "replace", "signup": "transfer", "view": "save", "click": "hold"}
    rows = X.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("cat_id"), lookup(actions, F.col("event_type")).alias("action"), F.struct("value", "event_id").alias("rank"))
    return first_of(rows, "user_id", "rank")


@query("""WITH t AS (SELECT p_partkey, '/lib/' || p_brand AS base FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS i FROM t)
          SELECT p_partkey, CASE WHEN base = '/lib/Brand#1' THEN base || '_' || CAST(CASE WHEN i >= 2 THEN i + 1 ELSE 1 END AS VARCHAR) WHEN i = 1 THEN base ELSE base || '_' || CAST(i - 1 AS VARCHAR) END AS final_path FROM r""")
def resolve_path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brand's plain path and its _2 are taken already."""
    rows = X.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/lib/"), "p_brand").alias("base"))
    taken = spark.createDataFrame([("/lib/Brand#1",), ("/lib/Brand#1_2",)], "to_path string")
    return without_collisions(rows, taken, "base", "p_partkey").select("p_partkey", "final_path")


RANKS = ["purchase", "view", "click", "error"]


@query("SELECT event_id, event_type AS reason, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE -1 END AS rank, user_id FROM events ORDER BY rank, user_id, event_id")
def report_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's lines: by the reason's rank (unlisted ones first), then path."""
    rank = F.coalesce(lookup({r: i for i, r in enumerate(RANKS)}, F.col("event_type")), F.lit(-1))
    return X.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("reason"), rank.alias("rank"), "user_id").orderBy("rank", "user_id", "event_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 250")
def limit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a backlog up to a limit, in a defined order."""
    return X.table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id").orderBy("event_id").limit(250)


@query(FX + "SELECT hash, to_path FROM cat WHERE doc_id % 3 = 1 ORDER BY hash LIMIT 50")
def backup_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of rows waiting for backup (here missing = -1 for every third)."""
    rows = X.catalog(spark, sf_dir).withColumn("missing", F.when(F.col("doc_id") % 3 == 1, -1).otherwise(0))
    return rows.filter("missing = -1").select("hash", "to_path").orderBy("hash").limit(50)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_row_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query(FX + "SELECT to_path FROM cat WHERE state >= 200 ORDER BY to_path")
def sort_results_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.accepted(X.catalog(spark, sf_dir)).select("to_path").orderBy("to_path")
