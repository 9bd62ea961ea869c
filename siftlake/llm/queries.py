"""The training-data queries: thin wrappers of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_crc, scratch, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query()
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), least=0.8)


#: A production key comes from a secret store; this one keeps reruns alike.
SURROGATE_KEY = "siftlake-surrogates"


@query()
def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import replace_personal_data

    return replace_personal_data(table(spark, sf_dir, "documents"), SURROGATE_KEY)


@query()
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import cube_mix

    return cube_mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3.0)


@query()
def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    """
    WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
               FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.id AS query_id, c.id AS vec_id,
                 CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.id % 100 = 0 AND c.id <> q.id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """
)
def op5_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, scale=1024, k=10)


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict, train

    docs, fold = table(spark, sf_dir, "documents"), F.coalesce(doc_crc() % 3 == 1, F.lit(False))
    return predict(docs, train(docs.filter(~fold)), ["doc_id", fold.alias("held_out")])


@query()
def op7_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lattice_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"), doc_crc() % 10 == 0, public_tokenizers.path("piece_bpe_32k.model"), label="lang")


@query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import read_token_files, write_token_files

    path, folder = public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "tokens")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), path, folder, end_id=0), path, folder)


@query()
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)


@query()
def op10_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming_search import search

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query(
    """
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, piece
                    FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
    words AS (SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM (SELECT lang, p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces)),
    leads AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY p ORDER BY i)),
    grams AS (
      SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM leads GROUP BY lang, w1
      UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM leads WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM leads WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
    total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang),
    cand AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND f >= 10),
    cuts AS (SELECT c.lang, c.phrase, k, a, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score
             FROM cand c JOIN (VALUES (1), (2)) AS t (k) ON k < m
             JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
             JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM cuts) WHERE i = 1),
    inner2 AS (SELECT lang, phrase, max(a) AS most
               FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM cand WHERE m = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE m = 3) GROUP BY lang, phrase),
    kept AS (SELECT b.* FROM best b LEFT JOIN inner2 USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
    SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000
    """
)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, cover=50, top=2000, slices=2)


#: The rules of op12: verdict, host, path.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_SECOND = "('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.za', 'co.in', 'co.jp', 'ne.jp', 'or.jp', 'co.kr', 'com.br', 'com.cn', 'com.mx', 'com.tr')"
_WEIGHT = "1 / CASE WHEN coalesce(sum(n * (n - 1) * m * (1 - m)), 0) = 0 THEN 0.1::DOUBLE ELSE least(greatest(sum(power(bad - n * m, 2) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)), 1e-4::DOUBLE), 0.999::DOUBLE) END - 1"


@query(
    rf"""
    WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
    a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS address FROM p),
    b AS (SELECT *, regexp_matches(address, '^\[|^[0-9.]+$') AS numeric_, regexp_extract(address, '(?:[^.]+\.)?[^.]+$') AS two FROM a),
    d AS (SELECT *, CASE WHEN numeric_ THEN address WHEN two IN {_SECOND} THEN two ELSE regexp_extract(address, '[^.]+$') END AS suffix,
                 CASE WHEN numeric_ THEN address WHEN two IN {_SECOND} THEN regexp_extract(address, '(?:[^.]+\.)?[^.]+\.[^.]+$') ELSE two END AS domain FROM b),
    o AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
    h AS (SELECT address, domain, suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM d LEFT JOIN o ON doc_id = page_id WHERE address <> '' GROUP BY address, domain, suffix),
    g AS (SELECT (sum(bad) + 1)::DOUBLE / (sum(n) + 2) AS m FROM h),
    s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM h, g GROUP BY suffix),
    s1 AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM s0, (SELECT {_WEIGHT} AS k FROM s0)),
    d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM h JOIN s1 USING (suffix) GROUP BY domain, suffix),
    d1 AS (SELECT domain, (bad + k * m) / (n + k) AS m FROM d0, (SELECT {_WEIGHT} AS k FROM d0)),
    h0 AS (SELECT address, n, bad, m FROM h JOIN d1 USING (domain)),
    h1 AS (SELECT address, n, k, (bad + k * m) / (n + k) AS s FROM h0, (SELECT {_WEIGHT} AS k FROM h0)),
    v AS (SELECT address, round(s - 1.645 * sqrt(s * (1 - s) / (n + k + 1)), 9) > 0.5 AS blocked FROM h1)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
    FROM (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM d) LEFT JOIN v USING (address)
    """
)
def op12_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the label under its id: bad if toxic or of low quality."""
    from .reputation import judge_urls

    toxic, quality = F.col("toxic"), F.col("quality")
    bad = F.coalesce(toxic == 1, F.lit(False)) | F.coalesce(quality == 0, F.lit(False))
    outcomes = table(spark, sf_dir, "labels").filter(toxic.isNotNull() | quality.isNotNull()).select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES, most=0.5, z=1.645)


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), every=199, shortest=6, least=5, times=5)
