"""Queries: predicates, validation, patches and configuration."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import numbers as N
from siftlake.functions.paths import lookup
from siftlake.functions.settings import layered
from siftlake.operators import judging as J
from siftlake.operators import matching as M
from siftlake.sources import fixtures as X

from .registry import query

FX = X.BASE

# Extensions of each kind of file, and the engine's own two.
KINDS = {"jpg": "IMAGE", "png": "IMAGE", "mkv": "VIDEO", "mp3": "AUDIO", "txt": "TEXT", "zip": "ARCHIVE", "db": "SCRAP"}
OWN = {"hcache": "CACHE", "lck": "LOCK"}
STATES = {-1: "erased", 0: "blocked", 100: "deduped", 200: "accepted", 300: "keeping"}

EXT = "CASE p_partkey % 9 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPG' WHEN 2 THEN 'mkv' WHEN 3 THEN 'mp3' WHEN 4 THEN 'hcache' WHEN 5 THEN 'HCACHE' WHEN 6 THEN 'lck' WHEN 7 THEN 'Db' ELSE 'bin' END"


def _ext() -> Column:
    return F.element_at(F.array(*[F.lit(e) for e in ("jpg", "JPG", "mkv", "mp3", "hcache", "HCACHE", "lck", "Db", "bin")]), (F.col("p_partkey") % 9 + 1).cast("int"))


def kind_of(ext: Column) -> Column:
    """Own extensions count only as written; others in any case."""
    return F.coalesce(lookup(OWN, ext), lookup(KINDS, F.lower(ext)), F.lit("UNKNOWN"))


def matches(text: Column, rules: list[tuple[str, bool]], whole: bool) -> Column:
    """Any rule holds: a pattern found in the text, or a text equal to (whole) or inside it, whatever the case."""
    hit = lambda v, pattern: text.rlike(v) if pattern else (F.lower(text) == v.lower() if whole else F.contains(F.lower(text), F.lit(v.lower())))
    return reduce(or_, (hit(*r) for r in rules), F.lit(False))


KIND_SQL = f"CASE WHEN e = 'hcache' THEN 'CACHE' WHEN e = 'lck' THEN 'LOCK' WHEN lower(e) = 'jpg' THEN 'IMAGE' WHEN lower(e) = 'mkv' THEN 'VIDEO' WHEN lower(e) = 'mp3' THEN 'AUDIO' WHEN lower(e) = 'db' THEN 'SCRAP' ELSE 'UNKNOWN' END"


@query(f"SELECT p_partkey, e AS ext, {KIND_SQL} AS kind FROM (SELECT p_partkey, {EXT} AS e FROM part)")
def classify_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "part").select("p_partkey", _ext().alias("ext")).withColumn("kind", kind_of(F.col("ext")))


@query(FX + "SELECT doc_id, regexp_matches(name, '^the .*on') OR lower(name) IN ('that it', 'the') AS ng FROM feat")
def filter_ng_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.features(spark, sf_dir).select("doc_id", matches(F.col("name"), [("^the .*on", True), ("That It", False), ("the", False)], True).alias("ng"))


@query(FX + "SELECT doc_id, from_path FROM feat WHERE regexp_matches(from_path, 'src1[0-3]') OR contains(lower(from_path), '/src5/de')")
def filter_ng_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.features(spark, sf_dir).filter(matches(F.col("from_path"), [("src1[0-3]", True), ("/SRC5/de", False)], False)).select("doc_id", "from_path")


@query(FX + "SELECT doc_id FROM feat WHERE name IN ('that it', 'of') OR regexp_matches(name, '^an')")
def filter_whitelist_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.features(spark, sf_dir).filter(F.col("name").isin("that it", "of") | F.col("name").rlike("^an")).select("doc_id")


#: Least size, pixels and long side of each type; no entry or 0 asks nothing.
LEAST = {"size": {"en": 500, "de": 300, "fr": 0}, "pixels": {"en": 2000, "es": 500}, "side": {"en": 100, "de": 150}}


def below(value: Column, what: str) -> Column:
    """Whether a value is under its type's minimum."""
    return F.coalesce(value < lookup({k: v for k, v in LEAST[what].items() if v}, F.col("type")), F.lit(False))


LOW = {
    "size": "coalesce(size < CASE type WHEN 'en' THEN 500 WHEN 'de' THEN 300 END, false)",
    "pixels": "coalesce(width * height < CASE type WHEN 'en' THEN 2000 WHEN 'es' THEN 500 END, false)",
    "side": "coalesce(greatest(width, height) < CASE type WHEN 'en' THEN 100 WHEN 'de' THEN 150 END, false)",
}
GATE = f"CASE WHEN damaged THEN 'TYPE_DAMAGED' WHEN {LOW['size']} THEN 'TYPE_LOW_FILE_SIZE' WHEN {LOW['pixels']} THEN 'TYPE_LOW_RESOLUTION' WHEN {LOW['side']} THEN 'TYPE_LOW_LONG_SIDE' END"


def quality_reason() -> Column:
    """The first quality test a row fails; null if it fails none."""
    return (
        F.when(F.col("damaged"), "TYPE_DAMAGED")
        .when(below(F.col("size"), "size"), "TYPE_LOW_FILE_SIZE")
        .when(below(F.col("width") * F.col("height"), "pixels"), "TYPE_LOW_RESOLUTION")
        .when(below(F.greatest("width", "height"), "side"), "TYPE_LOW_LONG_SIDE")
    )


@query(FX + f"SELECT doc_id, size FROM feat WHERE {LOW['size']}")
def filter_low_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.features(spark, sf_dir).filter(below(F.col("size"), "size")).select("doc_id", "size")


@query(FX + f"SELECT doc_id, width, height FROM feat WHERE {LOW['pixels']}")
def filter_low_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.features(spark, sf_dir).filter(below(F.col("width") * F.col("height"), "pixels")).select("doc_id", "width", "height")


@query(FX + f"SELECT doc_id FROM feat WHERE {LOW['side']}")
def filter_low_long_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.features(spark, sf_dir).filter(below(F.greatest("width", "height"), "side")).select("doc_id")


@query(FX + f"SELECT doc_id, {GATE} AS reason FROM feat")
def quality_gate_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.features(spark, sf_dir).select("doc_id", quality_reason().alias("reason"))


@query(FX + "SELECT doc_id, state FROM cat WHERE state >= 200")
def filter_accepted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.accepted(X.catalog(spark, sf_dir)).select("doc_id", "state")


@query(f"SELECT p_partkey, {KIND_SQL} AS kind FROM (SELECT p_partkey, {EXT} AS e FROM part) WHERE {KIND_SQL} IN ('UNKNOWN', 'CACHE', 'LOCK', 'SCRAP')")
def filter_forget_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no lookup is made for."""
    return classify_by_extension(spark, sf_dir).filter(F.col("kind").isin("UNKNOWN", "CACHE", "LOCK", "SCRAP")).select("p_partkey", "kind")


@query(f"""SELECT p_partkey, CASE kind WHEN 'UNKNOWN' THEN 'hold' WHEN 'CACHE' THEN CASE WHEN p_partkey % 3 = 0 THEN 'hold' ELSE 'delete' END WHEN 'LOCK' THEN 'delete' WHEN 'SCRAP' THEN 'delete' ELSE 'none' END AS action,
           CASE kind WHEN 'UNKNOWN' THEN 'TYPE_UNKNOWN_FILE_TYPE' WHEN 'CACHE' THEN CASE WHEN p_partkey % 3 = 0 THEN 'TYPE_KEEP_OWN_FILE' ELSE 'TYPE_SWEEP_OWN_FILE' END WHEN 'LOCK' THEN 'TYPE_SWEEP_OWN_FILE' WHEN 'SCRAP' THEN 'TYPE_SCRAP_FILE_TYPE' END AS reason
           FROM (SELECT p_partkey, {KIND_SQL} AS kind FROM (SELECT p_partkey, {EXT} AS e FROM part))""")
def file_type_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown files are held, scrap and locks deleted, caches held while their source (here every third) exists."""
    rows = classify_by_extension(spark, sf_dir)
    sources = rows.filter("p_partkey % 3 = 0").select("p_partkey", F.lit(True).alias("present"))
    v = J.kind_verdict(F.col("kind"), F.coalesce("present", F.lit(False)))
    return rows.join(sources, "p_partkey", "left").select("p_partkey", F.coalesce(v["action"], F.lit("none")).alias("action"), v["reason"].alias("reason"))


@query("SELECT event_id, regexp_matches(t, '[0-9]+') AS valid FROM (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN event_type ELSE event_type || CAST(user_id AS VARCHAR) END AS t FROM events)")
def validate_feature_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("user_id") % 3 == 0, F.col("event_type")).otherwise(F.concat("event_type", F.col("user_id").cast("string")))
    return X.table(spark, sf_dir, "events").select("event_id", t.rlike("[0-9]+").alias("valid"))


@query(FX + """SELECT n.doc_id, CASE WHEN n.doc_id % 4 <> 0 THEN false WHEN n.damaged THEN true WHEN c.to_path IS NULL THEN false ELSE c.to_path IN (SELECT to_path FROM listing) END AS needless
               FROM inc n LEFT JOIN cat c USING (hash)""")
def insert_needless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows in the erased state (every fourth): damaged ones needn't be inserted, nor those whose stored file exists."""
    stored = M.exists(X.catalog(spark, sf_dir), X.listing(spark, sf_dir)).select("hash", "present")
    rows = X.incoming(spark, sf_dir).join(stored, "hash", "left")
    needless = F.when(F.col("doc_id") % 4 != 0, False).when(F.col("damaged"), True).otherwise(F.coalesce("present", F.lit(False)))
    return rows.select("doc_id", needless.alias("needless"))


@query(FX + "SELECT doc_id, CASE state WHEN 0 THEN 'blocked' WHEN 100 THEN 'deduped' WHEN 200 THEN 'accepted' ELSE 'keeping' END AS state_name, state AS ordinal FROM cat")
def state_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States to names and back; an unknown one fails the job."""
    rows = X.catalog(spark, sf_dir).select("doc_id", lookup(STATES, F.col("state").cast("int")).alias("state_name"))
    rows = rows.withColumn("ordinal", lookup({v: k for k, v in STATES.items()}, F.col("state_name")).cast("long"))
    return rows.filter(F.assert_true(F.col("ordinal").isNotNull()).isNull())


@query("SELECT event_id, CAST((CASE WHEN value > 10 THEN 1 ELSE 0 END) + (CASE WHEN user_id % 2 = 0 THEN 2 ELSE 0 END) + (CASE WHEN event_type = 'view' THEN 4 ELSE 0 END) AS BIGINT) AS field, event_type = 'view' AS third FROM events")
def bitmask_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = N.bits(F.col("value") > 10, F.col("user_id") % 2 == 0, F.col("event_type") == "view")
    return X.table(spark, sf_dir, "events").select("event_id", field.alias("field")).withColumn("third", N.flag(F.col("field"), 2))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS code, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'purchase' END AS name FROM events")
def enum_code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = {"view": 0, "click": 1, "purchase": 2}
    code = F.coalesce(lookup(codes, F.col("event_type")), F.lit(-1))
    return X.table(spark, sf_dir, "events").select("event_id", code.alias("code")).withColumn("name", lookup({v: k for k, v in codes.items()}, F.col("code")))


@query(FX + "SELECT doc_id, name FROM cat WHERE type = 'fr'")
def query_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_value(X.catalog(spark, sf_dir), "type", "fr").select("doc_id", "name")


def by_value(rows: DataFrame, column: str, value) -> DataFrame:
    if column not in rows.columns:
        raise ValueError(f"no column {column}")
    return rows.filter(F.col(column) == F.lit(value))


@query("""SELECT event_id, user_id % 7 <> 0 AND event_type <> 'error' AS valid FROM events""")
def validate_update_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch is valid if its keys are allowed and its values of their type; here every seventh user sends an unknown key and errors send text for a number."""
    k = F.get_json_object("props", "$.k")
    payload = F.concat(F.lit('{"'), F.when(F.col("user_id") % 7 == 0, "rank").otherwise("rating"), F.lit('": '), F.when(F.col("event_type") == "error", F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k), F.lit("}"))
    rows = X.table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    given = F.map_keys(F.from_json("payload", "map<string,string>"))
    allowed = F.size(F.array_except(given, F.array(F.lit("rating"), F.lit("view_count")))) == 0
    typed = F.coalesce(F.schema_of_variant(F.parse_json("payload")).rlike('rating: BIGINT|^OBJECT<>$'), F.lit(False))
    return rows.select("event_id", (allowed & typed).alias("valid"))


@query("WITH " + X.PATCHES + """, st AS (SELECT hash, arg_max(rating, event_id) FILTER (WHERE rating IS NOT NULL) AS rating, count(view_date) AS views FROM pt GROUP BY hash)
       SELECT CAST(c_custkey AS VARCHAR) AS hash, coalesce(rating, 0) AS rating, coalesce(views, 0) AS view_count FROM customer LEFT JOIN st ON st.hash = CAST(c_custkey AS VARCHAR)""")
def apply_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known rows with what patches set last over their defaults; patches of unknown keys are left out."""
    patched = X.patches(spark, sf_dir).groupBy("hash").agg(F.max_by("rating", F.when(F.col("rating").isNotNull(), F.col("event_id"))).alias("rating"), F.count("view_date").alias("views"))
    known = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("hash"))
    return known.join(patched, "hash", "left").select("hash", F.coalesce("rating", F.lit(0)).cast("long").alias("rating"), F.coalesce("views", F.lit(0)).cast("long").alias("view_count"))


@query(FX + "SELECT doc_id, length(k) = 40 AND regexp_matches(k, '^[0-9a-f]+$') AND type IN ('en', 'de', 'fr') AS valid FROM (SELECT doc_id, type, CASE WHEN doc_id % 9 = 0 THEN substr(hash, 2) ELSE hash END AS k FROM feat)")
def validate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("doc_id") % 9 == 0, F.substring("hash", 2, 100)).otherwise(F.col("hash"))
    return X.features(spark, sf_dir).select("doc_id", ((F.length(key) == 40) & key.rlike("^[0-9a-f]+$") & F.col("type").isin("en", "de", "fr")).alias("valid"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 3 <> 0 THEN 'a=' || CAST(p_size AS VARCHAR) END, 'b=0', CASE WHEN p_brand <> 'Brand#1' THEN 'c=' || p_brand END) AS cells FROM part")
def null_bind_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty cells dropped, zeros kept."""
    cells = F.create_map(F.lit("a"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string")), F.lit("b"), F.lit("0"), F.lit("c"), F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).otherwise(""))
    kept = F.map_filter(cells, lambda k, v: v.isNotNull() & (v != ""))
    return X.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("cells"))


#: place, kind, match, setting, value, forced: a configuration, as a table of a store would hold it.
RULES = [
    (1, "path", "src1", "least", "10", False), (2, "path", "/en/", "least", "20", False), (3, "path", "src12", "least", "30", False), (4, "path", "src5", "most", "7", False), (5, "path", "/de/", "most", "8", False),
    (6, "type", "es", "least", "99", False), (7, "path", "src13", "least", "40", True), (8, "path", "src1", "most", "9", True), (9, "type", "fr", "most", "11", True),
]


@query(FX + """SELECT doc_id, CAST(CASE WHEN contains(from_path, 'src13') THEN 40 WHEN type = 'es' THEN 99 WHEN contains(from_path, 'src12') THEN 30 WHEN contains(from_path, '/en/') THEN 20 WHEN contains(from_path, 'src1') THEN 10 ELSE 5 END AS BIGINT) AS least,
               CAST(CASE WHEN type = 'fr' THEN 11 WHEN contains(from_path, 'src1') THEN 9 WHEN contains(from_path, '/de/') THEN 8 WHEN contains(from_path, 'src5') THEN 7 ELSE 6 END AS BIGINT) AS most FROM feat""")
def resolve_layered_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each row by rules that are data: base, path rules in order, type rules, then the forced ones of both."""
    rules = spark.createDataFrame(RULES, "place int, kind string, match string, setting string, value string, forced boolean")
    found = layered(rules, F.col("from_path"), F.col("type"), {"least": 5, "most": 6})
    return X.features(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in found.items()])
