"""Queries: scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import hashes as H
from siftlake.functions import landmarks as L
from siftlake.functions import numbers as N
from siftlake.functions import paths as P
from siftlake.functions import reasons as R
from siftlake.operators.images import pixel_features
from siftlake.sources import fixtures as X

from .registry import query

FX = X.BASE


@query("SELECT doc_id, sha1(text) AS sha1, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", *[H.content_digest(F.col("text"), a).alias(a) for a in ("sha1", "md5", "sha256")])


@query("""SELECT l_orderkey, l_linenumber, CAST(bit_count(xor(CAST(l_orderkey * 2654435761 AS UBIGINT), CAST(l_partkey * 40503 AS UBIGINT))) AS INTEGER) AS distance FROM lineitem""")
def hamming64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", H.hamming64(F.col("l_orderkey") * 2654435761, F.col("l_partkey") * 40503).alias("distance"))


@query(FX + "SELECT doc_id, CAST(p AS VARCHAR) AS p_hash FROM sim")
def phash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity hash of the words of each document, as unsigned text."""
    return X.features(spark, sf_dir, ("p_hash",)).filter(F.col("p_hash").isNotNull()).select("doc_id", F.conv(F.col("p_hash").cast("string"), 10, 16).alias("h")).select("doc_id", F.conv("h", 16, 10).alias("p_hash"))


@query("""SELECT vec_id, CAST(sum(CASE WHEN embedding[i + 1] < embedding[CASE WHEN i % 8 = 7 THEN i - 7 ELSE i + 1 END + 1] THEN (1::UBIGINT << CAST(i AS UBIGINT)) ELSE 0 END) AS VARCHAR) AS d_hash
          FROM embeddings, (SELECT range AS i FROM range(64)) GROUP BY vec_id""")
def dhash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = X.table(spark, sf_dir, "embeddings").select("vec_id", F.conv(H.gradient_hash(F.col("embedding")).cast("string"), 10, 16).alias("h"))
    return h.select("vec_id", F.conv("h", 16, 10).alias("d_hash"))


@query("""SELECT event_id, nullif(nullif(t, 'undefined'), '') AS clean, regexp_matches(coalesce(t, ''), '^[0-9]+$') AS valid
          FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'undefined' WHEN event_id % 4 = 1 THEN '' WHEN event_id % 4 = 2 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS t FROM events)""")
def hash_text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    t = F.when(k == 0, "undefined").when(k == 1, "").when(k == 2, F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    return X.table(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", H.clean_hash_text(F.col("t")).alias("clean"), F.col("t").rlike("^[0-9]+$").alias("valid"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN l_quantity / (l_tax * 100) ELSE 0 END AS ratio FROM lineitem")
def aspect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.aspect_ratio(F.col("l_quantity"), F.col("l_tax") * 100).alias("ratio"))


@query(r"""SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(url, '([^/]*)$', 1) AS base,
           regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS name, regexp_extract(url, '[^/]+(\.[^./]*)$', 1) AS ext FROM pages""")
def parse_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return X.table(spark, sf_dir, "pages").select("page_id", P.directory(u).alias("dir"), P.base_name(u).alias("base"), P.stem(u).alias("name"), P.extension(u).alias("ext"))


#: Paths with marks of all kinds, one a part.
MARKED = """mk AS (SELECT p_partkey, '/lib/' || CASE p_partkey % 5 WHEN 0 THEN '!block/' WHEN 1 THEN 'a/!hold/' ELSE '' END || replace(p_name, ' ', '_') ||
  CASE p_partkey % 4 WHEN 0 THEN '.!s' WHEN 1 THEN '.!rd' WHEN 2 THEN '.!ut' ELSE '' END || '.jpg' AS path FROM part)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(F.lit("/lib/"), F.when(k % 5 == 0, "!block/").when(k % 5 == 1, "a/!hold/").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(k % 4 == 0, ".!s").when(k % 4 == 1, ".!rd").when(k % 4 == 2, ".!ut").otherwise(""), F.lit(".jpg"))
    return X.table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


@query(f"""WITH {MARKED} SELECT p_partkey, path, CASE p_partkey % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'hold' ELSE
           CASE p_partkey % 4 WHEN 0 THEN 'save' WHEN 1 THEN 'replace,dedupe' ELSE '' END END AS marks FROM mk""")
def extract_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("p_partkey", "path", F.array_join(P.marks(F.col("path")), ",").alias("marks"))


@query(f"WITH {MARKED} SELECT p_partkey, replace(replace(regexp_replace(path, '\\.![a-z]+', ''), '!block/', ''), '!hold/', '') AS path FROM mk")
def strip_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("p_partkey", P.without_marks(F.col("path")).alias("path"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/in/' || p_type || '/' || p_brand || '.jpg' ELSE
          '/in/' || p_type || '/' || CASE p_partkey % 3 WHEN 1 THEN '[!_' || CAST(p_size AS VARCHAR) || ']' ELSE '' END || p_brand || CASE p_partkey % 3 WHEN 1 THEN '.!s' ELSE '.!hr' END || '.jpg' END AS path FROM part""")
def add_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    path = F.concat(F.lit("/in/"), "p_type", F.lit("/"), "p_brand", F.lit(".jpg"))
    letters = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("s"))).otherwise(F.array(F.lit("h"), F.lit("r")))
    return X.table(spark, sf_dir, "part").select("p_partkey", P.with_marks(path, letters, F.when(k == 1, F.col("p_size").cast("string")).otherwise("")).alias("path"))


#: Every reason, dealt over the events.
REASON_LIST = R.every_reason()
REASON_SQL = f"list_extract([{', '.join(f"'{r}'" for r in REASON_LIST)}], CAST(event_id % {len(REASON_LIST)} + 1 AS INTEGER))"


def _reason():
    return F.element_at(F.array(*[F.lit(r) for r in REASON_LIST]), (F.col("event_id") % len(REASON_LIST) + 1).cast("int"))


@query(f"""SELECT event_id, CASE WHEN t = '' THEN 'REPLACE' ELSE t END AS token FROM (SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({REASON_SQL}, 'TYPE_', ''), 'P_HASH_', ''), 'MATCH($|_)', ''), 'REJECT_', '') AS t FROM events)""")
def reason_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short token of a reason; nothing left means a plain replacement."""
    return X.table(spark, sf_dir, "events").select("event_id", R.token(_reason()).alias("token"))


@query(f"""SELECT event_id, CASE {REASON_SQL} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.MARK_OF.items())} ELSE '' END AS marks FROM events""")
def reason_to_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "events").select("event_id", F.coalesce(P.lookup(R.MARK_OF, _reason()), F.lit("")).alias("marks"))


@query(r"SELECT page_id, lower(replace(regexp_replace(regexp_replace(url, '[0-9]+', 'N'), 'e', 'E', 'g'), 'http://', '')) AS path FROM pages")
def rename_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("[0-9]+", "N", False), ("e", "E", True), ("http://", ""), F.lower]
    return X.table(spark, sf_dir, "pages").select("page_id", P.rename(F.col("url"), rules).alias("path"))


DUPLICATED = "'/x/' || p_brand || '/' || p_type || '/' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END || '/' || p_brand || '.jpg'"


def _duplicated():
    return F.concat(F.lit("/x/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")), F.lit("/"), "p_brand", F.lit(".jpg"))


@query("SELECT p_partkey, '/x/' || p_brand || '/' || p_type || '/' || p_brand || '.jpg' AS path FROM part")
def dedupe_dir_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "part").select("p_partkey", P.dedupe_tokens(_duplicated()).alias("path"))


@query("SELECT p_partkey, '/dest/' || replace(p_brand, '#', '-') || '/' || lower(p_type) || '/' || replace(p_brand, '#', '-') || '.jpg' AS path FROM part")
def converge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("#", "-"), lambda p: F.concat(F.regexp_extract(p, "^(/[^/]*)", 1), F.regexp_replace(F.lower(F.regexp_extract(p, "^/[^/]*(/.*/)[^/]*$", 1)), "brand", "Brand"), P.base_name(p))]
    return X.table(spark, sf_dir, "part").select("p_partkey", P.converged(_duplicated(), "/x", "/dest", rules).alias("path"))


BASES = {"view": "/lib/view", "click": "/lib/click"}


@query("""SELECT event_id, '/lib/' || event_type || '/' || strftime(ts - INTERVAL 5 HOUR, '%Y') || '/' || strftime(ts - INTERVAL 5 HOUR, '%m-%d') || '/' || CAST(user_id AS VARCHAR) AS path
          FROM events WHERE event_type IN ('view', 'click')""")
def library_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "events").filter(F.col("event_type").isin(*BASES))
    return rows.select("event_id", P.library_path(BASES, F.col("event_type"), F.col("ts").cast("timestamp_ntz"), 5, F.col("user_id").cast("string")).alias("path"))


@query("SELECT page_id, starts_with(url, 'http://th') AS inside FROM pages")
def is_library_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "pages").select("page_id", F.startswith("url", F.lit("http://th")).alias("inside"))


@query("SELECT p_partkey, '/cloud/' || p_type || '/' || p_name AS path FROM part")
def cloud_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drive off, back slashes turned, base in front."""
    local = F.concat(F.lit("C:\\"), "p_type", F.lit("\\"), "p_name")
    return X.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/cloud"), F.replace(F.regexp_replace(local, "^[A-Za-z]:", ""), F.lit("\\"), F.lit("/"))).alias("path"))


@query(FX + "SELECT DISTINCT f AS folder FROM (SELECT unnest(['/in', '/in/' || source, '/in/' || source || '/' || type]) AS f FROM feat)")
def path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.features(spark, sf_dir).select(F.explode(P.ancestors(F.col("from_path"))).alias("folder")).distinct()


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: l <> '' AND NOT regexp_matches(l, '^[A-Z][a-z]+ '))) > 0 AS damaged FROM documents")
def damage_from_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any non-empty line of output isn't on the list of harmless ones."""
    harmless = "^[A-Z][a-z]+ "
    return X.table(spark, sf_dir, "documents").select("doc_id", F.exists(F.split("text", "\n"), lambda l: (l != "") & ~l.rlike(harmless)).alias("damaged"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) END AS width, CAST(p_size * 2 AS BIGINT) AS height FROM part""")
def extract_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """width= and height= of a probe's text, 0 where absent."""
    text = F.concat(F.lit("stream"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("\nwidth="), "p_size")), F.lit("\nheight="), (F.col("p_size") * 2).cast("string"), F.lit("\n"))
    value = lambda k: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("t", f"{k}=([0-9]+)", 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("long").alias(k)
    return X.table(spark, sf_dir, "part").select("p_partkey", text.alias("t")).select("p_partkey", value("width"), value("height"))


@query(FX + r""", ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0),
       g AS (SELECT doc_id, c, count(*) AS n FROM ch WHERE c <> '' GROUP BY doc_id, c),
       s AS (SELECT doc_id, sum(n) AS total, sum(n * ord(c)) AS points, sum(n * log2(n)) AS nlogn FROM g GROUP BY doc_id)
       SELECT doc_id, round(points / total, 6) AS mean, round(log2(total) - nlogn / total, 6) AS entropy,
              CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) * 100.0 / len(w), 6) ELSE 0 END::DOUBLE AS quality FROM s JOIN tok USING (doc_id)""")
def pixel_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, entropy and a quality measure of each item; for texts of code points and words."""
    return X.statistics(spark, sf_dir).select("doc_id", F.round("mean", 6).alias("mean"), F.round("entropy", 6).alias("entropy"), F.round("quality", 6).cast("double").alias("quality"))


@query("""SELECT l_orderkey, l_linenumber, round(10 + (l_quantity - 10) * cos(radians(l_linenumber * 30)) - (l_discount * 100 - 5) * sin(radians(l_linenumber * 30)), 5) + 0.0 AS x,
          round(5 + (l_quantity - 10) * sin(radians(l_linenumber * 30)) + (l_discount * 100 - 5) * cos(radians(l_linenumber * 30)), 5) + 0.0 AS y FROM lineitem""")
def rotate_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = N.rotated(F.col("l_quantity"), F.col("l_discount") * 100, F.lit(10.0), F.lit(5.0), F.col("l_linenumber") * 30)
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.round(x, 5) + 0.0).alias("x"), (F.round(y, 5) + 0.0).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt((l_quantity - 3) ** 2 + (l_tax * 100 - 4) ** 2), 6) AS distance FROM lineitem")
def point_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.distance(F.col("l_quantity"), F.col("l_tax") * 100, F.lit(3.0), F.lit(4.0)), 6).alias("distance"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + (l_quantity - 1) * 0.25, 6) AS x, round(l_discount * 100 + (l_discount * 100 - 2) * 0.25, 6) AS y FROM lineitem")
def extend_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = N.extended(F.lit(1.0), F.lit(2.0), F.col("l_quantity"), F.col("l_discount") * 100, F.lit(25))
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, round(x0 + (x0 - x3) * 0.2, 4) AS x0, round(y0 + (y0 - y3) * 0.2, 4) AS y0, round(x1 + (x1 - x0) * 0.3, 4) AS x1, round(y1 + (y1 - y0) * 0.3, 4) AS y1,
                 round(x2 + (x2 - x3) * 0.3, 4) AS x2, round(y2 + (y2 - y3) * 0.3, 4) AS y2, round(x3 + (x3 - x0) * 0.2, 4) AS x3, round(y3 + (y3 - y0) * 0.2, 4) AS y3,
                 round(x0 + (x0 - x1) * 0.05, 4) AS top_x0, round(y3 + (y3 - y2) * 0.05, 4) AS top_y3
          FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_tax * 100 + 1 AS y0, l_quantity + 1 AS x1, (l_tax * 100 + 1) * 3 AS y1, l_quantity * 2 AS x2, (l_tax * 100 + 1) * 3 + 2 AS y2, l_quantity * 2 + 1 AS x3, l_tax * 100 + 2 AS y3 FROM lineitem)""")
def expand_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilted boxes pushed out on their four sides (top by 5 %, left and right by 20 %, bottom by 30 %), and two coordinates of a push of the top alone."""
    q, p = F.col("l_quantity"), F.col("l_tax") * 100 + 1
    corners = [(q, p), (q + 1, p * 3), (q * 2, p * 3 + 2), (q * 2 + 1, p + 1)]
    full, top = N.expanded_quad(corners, top=5, right=20, left=20, bottom=30), N.expanded_quad(corners, top=5)
    points = [F.round(c, 4).alias(f"{n}{i}") for i, xy in enumerate(full) for n, c in zip("xy", xy)]
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *points, F.round(top[0][0], 4).alias("top_x0"), F.round(top[3][1], 4).alias("top_y3"))


@query("""SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 0.4 + 0.5) AS BIGINT) AS width, CAST(floor(l_extendedprice / 0.4 + 0.5) AS BIGINT) AS top FROM lineitem""")
def rescale_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes found on a reduced image, back at full size, rounded."""
    box = F.transform_values(F.create_map(F.lit("width"), F.col("l_quantity"), F.lit("top"), F.col("l_extendedprice")), lambda k, v: F.floor(v / 0.4 + 0.5))
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", F.col("b")["width"].alias("width"), F.col("b")["top"].alias("top"))


def _landmarks(spark, sf_dir):
    """A landmark for each part: its points differ by their place in the order, but are held in another one."""
    p = lambda i: F.struct((F.col("p_size") + i).cast("long").alias("x"), (F.col("p_size") * (i + 1)).cast("long").alias("y"))
    cells = [x for i, n in reversed(list(enumerate(L.POINTS))) for x in (F.lit(n), p(i))]
    # a row costs far more here than in its file, which may be read by one task
    rows = X.table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return rows.select("p_partkey", F.create_map(*cells).alias("landmark"))


@query("SELECT p_partkey, array_to_string(list_transform(range(83), lambda i: CAST(p_size + i AS VARCHAR) || ',' || CAST(p_size * (i + 1) AS VARCHAR)), ';') AS landmarks FROM part")
def encode_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """83 named points in a fixed order as text; another number of points is an error."""
    return _landmarks(spark, sf_dir).select("p_partkey", L.encode(F.col("landmark")).alias("landmarks"))


@query("SELECT p_partkey, " + ", ".join(f"CAST(p_size + {i} AS BIGINT) AS {n}_x, CAST(p_size * {i + 1} AS BIGINT) AS {n}_y" for i, n in enumerate(L.POINTS)) + " FROM part")
def decode_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the map is in the points' order: columns are taken by place, without looking for 83 names twice
    rows = encode_landmarks(spark, sf_dir).select("p_partkey", F.map_values(L.decode(F.col("landmarks"))).alias("points"))
    return rows.select("p_partkey", *[F.get("points", F.lit(i))[a].alias(f"{n}_{a}") for i, n in enumerate(L.POINTS) for a in "xy"])


@query("""SELECT c_custkey, coalesce(CAST(n AS BIGINT), 0) AS view_count, coalesce(last, -1) AS view_date FROM customer
          LEFT JOIN (SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_type = 'view' GROUP BY user_id) ON user_id = c_custkey""")
def default_state_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every key, with defaults for keys never seen."""
    state = X.table(spark, sf_dir, "events").filter("event_type = 'view'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    return X.table(spark, sf_dir, "customer").join(state, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("view_count"), F.coalesce("last", F.lit(-1)).cast("long").alias("view_date"))


@query("SELECT p_brand, 't' || CAST((p_partkey * 7 + p_size) % 128 + 1 AS VARCHAR) AS tag, CAST(count(*) AS BIGINT) AS value FROM part GROUP BY 1, 2")
def tag_wide_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags to a wide row a key (128 explicit columns, so no pass to find them) and back to long form."""
    tags = [f"t{i}" for i in range(1, 129)]
    long = X.table(spark, sf_dir, "part").withColumn("tag", F.concat(F.lit("t"), (F.col("p_partkey") * 7 + F.col("p_size")) % 128 + 1))
    wide = long.groupBy("p_brand").pivot("tag", tags).count()
    return wide.unpivot("p_brand", tags, "tag", "value").filter("value is not null")


@query("WITH " + X.SCORES + """SELECT hash, string_agg(class_name || ' ' || printf('%.2f', floor(probability * 100 + 0.5) / 100), ',' ORDER BY probability DESC, class_name) AS labels FROM sc WHERE probability > 0.2 GROUP BY hash""")
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes over a probability, most likely first, as text."""
    kept = X.scores(spark, sf_dir).filter("probability > 0.2").groupBy("hash").agg(F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("p"), "class_name"))).alias("s"))
    return kept.select("hash", F.array_join(F.transform("s", lambda x: F.concat(x["class_name"], F.lit(" "), F.format_number(N.half_up(-x["p"], 2), 2))), ",").alias("labels"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids of ``embeddings`` as 8 x 8 grey images, in the form that the image source gives."""
    level = lambda v: F.least(F.greatest(F.floor(F.lit(128) + F.lit(127) * v.cast("double")), F.lit(0)), F.lit(255))
    data = F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(level(v)), 2, "0")), ""))
    field = {"origin": F.col("vec_id").cast("string"), "height": F.lit(8), "width": F.lit(8), "nChannels": F.lit(1), "mode": F.lit(0), "data": data}
    return X.table(spark, sf_dir, "embeddings").select(F.struct(*[c.alias(n) for n, c in field.items()]).alias("image"))


@query()
def image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hashes by cosine transform of the pixels; tests hold them against a brute-force transform."""
    return pixel_features(_images(spark, sf_dir)).select(F.col("origin").cast("long").alias("vec_id"), "p_hash", F.round("mean", 6).alias("mean"))


@query("""WITH v AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: least(greatest(floor(128 + 127 * CAST(x AS DOUBLE)), 0), 255))) AS level FROM embeddings),
          c AS (SELECT vec_id, level, count(*) AS n FROM v GROUP BY vec_id, level)
          SELECT vec_id, round(sum(level * n) / sum(n), 6) AS mean, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY vec_id""")
def image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and entropy of the pixels of each image."""
    return pixel_features(_images(spark, sf_dir)).select(F.col("origin").cast("long").alias("vec_id"), F.round("mean", 6).alias("mean"), F.round("entropy", 6).alias("entropy"))
