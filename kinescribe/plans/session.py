"""Spark session settings this package expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Set on a cluster as well: sizes are decided at run time, skewed join partitions are split.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Building wide plans from Python is much faster without a call site per column.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, **extra: str) -> SparkSession:
    """Single-machine session for tests, the check tool and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("kinescribe")
    local = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**SETTINGS, **local, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables, as named by the cluster.

    Only where the session names none (tests on one machine) a temporary folder is used.
    """
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    created = tempfile.mkdtemp(prefix="kinescribe-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created
