"""Tables that a job writes between its steps: they cut lineage and outlive executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of this machine only where it is all there is."""
    found = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("DRIFTLINE_SCRATCH")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        found = os.environ["DRIFTLINE_SCRATCH"] = tempfile.mkdtemp(prefix="spark-driftline-")
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared one; it is not there yet."""
    return f"{shared_folder(spark)}/driftline-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """The same rows, written in a folder for each of the column's few values, so that one value is read by itself."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
