"""The training-corpus pipeline: language ID, line dedup, near-duplicate groups, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. What
one stage returns is written as Parquet and read again as the next stage's ``docs``.

* ``language_id`` drops documents without a determinable language (null text or no letter). The score
  is no reason to drop one: it is no common measure over families of different sizes, and low where duels run in a circle.
  The model is learned from the labelled two thirds of the stage's own input; ``lang`` keeps its value.
* ``line_dedup`` takes later occurrences of repeated three-line passages out of the texts. ``n_chars`` follows the text.
  Documents that lose all their text that way go.
* ``near_duplicates`` keeps, of each group of documents that links of Jaccard 0.75 connect, the one with the least doc_id.
  A document is a doc_id and a text: rows that repeat both are one document and stay or go together; rows with one doc_id
  and different texts are judged each by its own group, and of those that share a group and its least doc_id one text stays
  (the least hash).
* ``pack`` gives the pieces of sequences of at most 2048 tokens.

A column that the input lacks stays missing; rows with a null doc_id pass the first two stages and are kept by the third
as documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.llm import langid, line_dedup, packing, partenum, sieve
from tripflow.session import durable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs)
    said = langid.predicted(docs, model)
    return said.filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs)
    out = out.filter((F.col("n_removed") == 0) | (F.btrim(F.col("text"), F.lit(" \t\r\n")) != ""))
    if "n_chars" in docs.columns:
        own = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, own).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = partenum.jaccard_components(docs, keyed=True)
    gone = groups.filter("id <> first.id OR key <> first.key AND id IS NOT NULL").select(F.col("key").alias("__key")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    return sieve.without(keyed, durable(gone, "near-duplicates"), "__key").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, memo_entries=1 << 17, keep_vocabulary=False).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("line_dedup", drop_repeated_lines), ("near_duplicates", near_duplicates), ("packing", pack)]

ORACLE_SQL = None  # neither a trained classifier nor the tokenizer can be stated in SQL; tests/llm compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
