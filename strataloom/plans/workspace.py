"""Tables written in the folder that driver and executors share.

Lineage is cut by writing a table there and reading it again, so a lost executor costs a
re-read and never a recomputation of the plan before it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where local mode leaves it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="strataloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; its folder then goes with the cluster's own cleaning
        pass


class Workspace:
    """Tables of one operator call. What its result still reads stays until the application ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.path)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again."""
        df.write.mode("overwrite").parquet(self.at(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, self.at(name))
