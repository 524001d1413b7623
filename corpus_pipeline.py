"""A corpus from raw documents: language, shared lines, near-duplicates, benchmark leaks, token ids.

Each stage gets what the one before it kept, as a table read again from files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.llm import bpe, decontaminate, jaccard_join, language, line_dedup
from sparseloom.llm.common import materialize, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
def with_key(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text: rows without an id, and rows that share one, are documents of their own."""
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter go. lang becomes the predicted one."""
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    known = language.predict(docs, model, carry=COLUMNS).filter(F.col("lang_pred") != language.NO_LANGUAGE)
    return known.select(*(F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"carried.{c}").alias(c) for c in COLUMNS))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in the first document that has them; n_chars is counted anew. A document that loses all its lines stays with an empty text."""
    rest = line_dedup.line_dedup(docs, carry=("lang", "source"))
    return rest.select("doc_id", "text", F.col("carried.lang").alias("lang"), F.col("carried.source").alias("source"), F.length("text").cast("long").alias("n_chars"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id stays, one without an id only among its like. Of equal ids the smaller hash of id and text decides, of rows equal in both the smaller row."""
    keyed = with_key(docs)
    classes = jaccard_join.jaccard_join(keyed, "key").select(F.col("doc_id").alias("key"), "class_id")
    ids = keyed.select("key", "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = ids.join(classes, "key").groupBy("class_id").agg(F.min(order).alias("first")).select(F.col("first.key").alias("key"))
    kept = keyed.join(first, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return kept.select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    keyed = with_key(docs)
    leaks = decontaminate.find_leaks(keyed, read_table(spark, sf_dir, "benchmark"), "key")
    return keyed.join(leaks.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of each document, and digest of what they decode to."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language identification, near-duplicates by exact sets with trained and hashed parts, tiling and tokens are beyond SQL; the tests use brute force.
ORACLE_SQL = None
