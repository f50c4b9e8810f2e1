"""A corpus pipeline of four operators: quality rules, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispan.llm.common import Scratch, spread
from lexispan.llm.jaccard import near_duplicates
from lexispan.llm.packing import pack_documents
from lexispan.llm.quality import robust_quality
from lexispan.llm.suffixes import cut_repeats

PASSAGE_BYTES, PASSAGE_WORDS = 200, 51


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return robust_quality(docs).where("kept").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, once.

    A document is an id and a text: rows of one id, or of none, with other texts are documents of their
    own, and stay unless they are near duplicates. In a group a null id comes last, and of one id's texts
    the one of the least hash stays. Rows of the same id and text are one document.
    """
    mark = F.xxhash64("doc_id", "text")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), mark.alias("mark"))
    groups = near_duplicates(docs.select(key.alias("key"), "text"), id_col="key")
    first = groups.where(F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key.mark").alias("mark_"), F.col("key.id").alias("id_")).distinct()
    marked = docs.withColumn("mark_", mark)
    kept = marked.join(first.withColumnRenamed("mark_", "kept_"), (F.col("mark_") == F.col("kept_")) & F.col("doc_id").eqNullSafe(F.col("id_")), "left_semi")
    order = Window.partitionBy("mark_", "doc_id").orderBy("text", "lang", "source")
    return kept.withColumn("nth_", F.row_number().over(order)).where("nth_ = 1").drop("nth_", "mark_")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat go from every text; a character cut in two goes whole.

    Such a passage is a stretch that repeated strings of ``PASSAGE_BYTES`` bytes cover, with
    ``PASSAGE_WORDS`` words or more. 51 words of three letters are 203 bytes, so shorter passages than
    these bytes have unusually short words. Null texts stay null; rows that are equal in all columns are
    copies of each other. Extra columns are kept.
    """
    if "n_chars" not in docs.columns:
        return cut_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS)
    return cut_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS).select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", one_of_each_group), ("suffix-array dedup", without_repeats), ("best-fit packing", packed)]

#: Covariance estimates, shingle joins and tokenizers have no SQL; tests hold run() over a small table against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs, scratch = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
