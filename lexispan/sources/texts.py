"""Text sources and sinks: any batch or stream reader that gives an id and a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text) from parquet, orc, json or csv columns, or whole files by ``fmt='files'``."""
    if fmt == "files":
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return spark.read.format(fmt).options(**options).load(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def stream_texts(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None, **options) -> DataFrame:
    """(doc_id, text) as a stream: of the files at a path, new ones as they come, or of any other stream source.

    File sources need the types of their columns, which are taken from the files that are there; other
    sources (``fmt='rate'`` and the like) bring their own.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if fmt in ("parquet", "orc", "json", "csv"):
        known = spark.read.format(fmt).options(**options).load(path).schema
        reader = reader.schema(known)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(path) if path else reader.load()
    return rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def dealt(texts: DataFrame) -> DataFrame:
    """Texts dealt to all cores, where their scan has fewer splits than the session has cores."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts._jdf.queryExecution().toRdd().getNumPartitions() < cores else texts


def parts_of(texts: DataFrame, each: int) -> int:
    """How many parts of about ``each`` bytes a table's columns make, by the sizes of its files; one for each core at least."""
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // each))


def from_strings(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def from_words(spark: SparkSession, *sentences: list[str], doc_id: int = 0) -> DataFrame:
    """Sentences that are split already."""
    return spark.createDataFrame([(doc_id, k, list(w)) for k, w in enumerate(sentences)], "doc_id long, sent_idx int, words array<string>")
