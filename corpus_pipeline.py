"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Each stage decides on everything its predecessor kept, and its decisions take effect: rows go in the
first four, and the last encodes what is left. All but the last return the columns of documents, whatever those are.

Defined results, in every stage: decisions are by row, so of rows that share an id, or have none, each is decided for itself. A null or empty text is
a document like any other: it has no toxic sentence, is an exact copy of other empty texts, links with nothing, has no benchmark words
and encodes to no pieces. Very long texts are read whole. An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import decontaminate as decontamination
from strataloom.llm import exact_dedup, ngram_join, sentencepiece_codec
from strataloom.llm import toxicity as toxicity_model
from strataloom.llm.text import fresh_name, small_side
from strataloom.plans.workspace import Workspace


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Equal texts score alike; without labels nothing goes."""
    return toxicity_model.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest id stays, a null id last; of ties one row stays."""
    return exact_dedup.keep_unique(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links reach, the row with the smallest id stays, a null id last; of ties one row stays. Texts without words are in no group."""
    work, row, key = Workspace(spark, "pipeline-near-duplicates"), fresh_name(docs, "row"), F.col("doc_id").cast("long")
    numbered = work.table(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = ngram_join.jaccard_join(numbered, id_col=row)
    joined = work.table(found.where("id <> component").select("id", "component"), "joined")
    grouped = joined.union(joined.select("component", "component").distinct())
    size = 2 * joined.count()
    members = numbered.select(key.alias("doc_id"), F.col(row).alias("id")).join(small_side(grouped, size), "id")
    first = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id"))["id"].alias("id"))
    gone = work.table(grouped.join(small_side(first.select("id"), size), "id", "left_anti").select(F.col("id").alias(row)), "gone")
    return numbered.join(small_side(gone, size), row, "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows over at least a twentieth of their words go; an empty benchmark rejects nothing."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each remaining document, one row each; decoding gives back its text, the empty one for a null."""
    return sentencepiece_codec.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontaminate", decontaminate),
    ("sentencepiece", encode),
]

#: The toxicity model and the piece agenda can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
