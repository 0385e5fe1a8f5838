"""Tables, scratch storage and code shipping shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured rows times their width stay under this.
BROADCAST_BYTES = 4 << 20
#: Rows that travel to a Python worker as one Arrow batch. Spark's 10,000 rows with texts take 100 MB and more, in the
#: executor and in its worker, for each task; operators take slices of 256 rows from a batch anyway.
BATCH_ROWS = 1024
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of this machine only where it is all there is."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = os.environ.get("DRIFTLINE_SCRATCH")
        if not found:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir names no folder that all machines share")
            found = os.environ["DRIFTLINE_SCRATCH"] = tempfile.mkdtemp(prefix="spark-driftline-")
    return found


class Scratch:
    """Tables written in the shared folder: they cut lineage and outlive executors.

    `drop` removes one that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{checkpoint_dir(spark)}/driftline-{uuid.uuid4().hex}", {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = self.paths[name] = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def salted_left_join(rows: DataFrame, groups: DataFrame, keys: list[str], salt: Column, salts: int = 16) -> DataFrame:
    """Left join of many rows with one row per key: a hot key's rows are dealt over `salts` tasks.

    `groups` is repeated once for each salt. Null keys match null keys.
    """
    left = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless they find it by their own path, and bounds batches of rows.

    A session that names its own size of batches keeps it.
    """
    if RECORDS not in spark.conf.getAll:
        spark.conf.set(RECORDS, str(BATCH_ROWS))
    home = Path(__file__).resolve().parents[2]
    named = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if any(Path(p).resolve() == home for p in named):
        return
    sc = spark.sparkContext
    if getattr(sc, "_driftline_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="spark-driftline-"), "driftline_llm.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((home / "driftline").rglob("*.py")):
            z.write(p, p.relative_to(home))
    sc.addPyFile(out)
    if str(home) not in sys.path:
        sys.path.append(str(home))
    sc._driftline_shipped = True
