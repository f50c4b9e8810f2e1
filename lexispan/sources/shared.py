"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a session with a local master gets one of its own where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get(KEY, None) or sc.getConf().get(KEY) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError(f"{KEY} has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexispan-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")
