"""Intermediate tables in the shared folder of the cluster.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs a re-read and never a recomputation of everything before it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-lexloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator call; each may be dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lexloom-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: set[str] = set()

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the written table."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.paths.add(path)
        saved._scratch_path = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later plan reads."""
        self._delete({t._scratch_path for t in tables})

    def keep(self, *tables: DataFrame) -> None:
        """Delete all saved tables but these, which the operator's result reads."""
        self._delete(self.paths - {t._scratch_path for t in tables})

    def _delete(self, paths: set[str]) -> None:
        for name in paths & self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths -= paths
