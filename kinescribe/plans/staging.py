"""Intermediate tables.

Exact prefix values need a summary of the data before the data itself, so a chain of such operators would
read its input 2, 4, 8 ... times. Pipelines therefore write the tables that several later steps read (the
trace, its derivatives, the episodes) once and go on from the written files: the lineage ends there, later
scans read only the columns they need, and a lost executor costs a re-read instead of a recomputation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinescribe.plans.session import checkpoint_root


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """New path below the shared checkpoint folder; its file system deletes it when the driver ends."""
    path = f"{checkpoint_root(spark)}/kinescribe-{kind}/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{fresh_folder(spark, 'stages')}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
