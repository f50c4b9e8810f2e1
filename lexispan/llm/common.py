"""What the corpus operators share: input checks and tables in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in ``spark.checkpoint.dir``.

    Where none is named, a session on one machine (a local master, as in tests) gets a temporary folder;
    on a cluster that raises ValueError, as such a folder would not be shared.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_KEY} has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexispan-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage and to survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/lexispan-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write ``df`` once and return a frame that reads the table."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.load(name, df)

    def save_few(self, df: DataFrame, name: str) -> DataFrame:
        """The same for a table of short rows: one file for eight of the session's shuffle partitions.

        Hadoop's local file system runs three commands for each file it makes. Until such a child runs its
        command it shares the executor's memory, and what adds up processes counts that memory twice.
        """
        files = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)
        return self.save(df.repartition(files), name)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table that no frame reads any more."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name))
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by those names; other columns and clashing names cannot matter."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan dealt to all cores, where it has fewer splits than the session has cores.

    A file of one row group is read by one task, and the work on its texts would stay there. Larger inputs
    have more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def release(spark: SparkSession) -> None:
    """Let the driver forget shuffles that nothing refers to any more, so their files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): for each node of the edges (a, b), the smallest node it is connected to.

    Each round a node takes the least label of itself and its neighbours, then the label of that
    label, so the rounds needed grow with the logarithm of a component's width.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = scratch.save(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-both")
    labels = scratch.save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        seen = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(seen, "u").select("u", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("u").alias("low"), F.col("label").alias("beyond"))
        moved = scratch.save(lower.join(jump, "low", "left").select("u", F.least("low", F.coalesce("beyond", "low")).alias("label"), (F.col("label") != F.least("low", F.coalesce("beyond", "low"))).alias("moved")), f"{name}-{k}")
        labels = moved.select("u", "label")
        still = moved.where("moved").limit(1).count()
        scratch.drop(f"{name}-{k - 1}")
        if not still:
            scratch.drop(f"{name}-both")
            return labels.withColumnRenamed("u", "node")
