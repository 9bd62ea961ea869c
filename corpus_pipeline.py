"""The corpus pipeline: documents go through five stages, each over all that the one before kept.

1. language ID: documents without a language (null text, no letters), whose language is
   ambiguous, or whose n-grams fit no language better than chance are rejected;
2. near-dedup: of each class of near duplicates the document with the least doc_id stays;
3. personal data: entities become keyed surrogates;
4. mixing: sources are brought to their target weights; a document comes as often as it is
   taken;
5. pieces: texts are encoded to piece ids; the text that goes out is decoded from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import common, langid, mixing, order_minhash, pieces, surrogates
from siftlake.llm.queries import SURROGATE_KEY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(docs: DataFrame, *first: Column) -> DataFrame:
    """docs with ``row``, which tells rows of equal ids and texts apart; written, so that all that is made of it sees the same numbers."""
    return common.cut(docs.select(*COLUMNS).withColumn("row", F.struct(*first, F.monotonically_increasing_id().alias("n"))), "numbered")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.filter(F.coalesce(common.doc_crc() % 3 != 1, F.lit(True))))
    kept = langid.predict(docs, model, [F.col(c) for c in COLUMNS], fit=True)
    return kept.filter((F.col("lang_pred") != "und") & ~F.col("ambiguous") & (F.col("fit") > 0)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows of equal ids and texts are one document
    docs = docs.select(*COLUMNS).withColumn("row", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", common.text_key().alias("key")))
    classes = order_minhash.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"))
    stay = classes.filter(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("row")).distinct()
    return docs.join(stay, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.replace_personal_data(docs, SURROGATE_KEY).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs, F.col("doc_id"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    taken = mixing.cube_mix(docs.select(F.col("row").alias("doc_id"), "source", "text")).select(F.col("doc_id").alias("row"), "copies").filter("copies > 0")
    return docs.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    return coded.withColumnRenamed("decoded", "text").select(*COLUMNS, "piece_ids")


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("personal data", personal_data), ("mixing", mix_sources), ("pieces", piece_ids)]
#: No stage can be said in SQL as a whole; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
