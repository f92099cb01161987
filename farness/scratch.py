"""Tables in the folder that driver and executors share; they cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where neither the session nor the context names one and driver and executors are one machine (tests) a temporary folder is
    set; on a cluster that is an error, since every executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='farness-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Parquet tables under the shared folder: they cut lineage and outlive lost executors.

    A table goes when drop() names it, the rest when the process ends with its session still up.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}", 0
        atexit.register(self._leave)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Writes df and returns what was written; a name is used once."""
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def cut(self, df: DataFrame) -> DataFrame:
        """keep() under a name of its own."""
        self.n += 1
        return self.keep(df, f"cut-{self.n}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))

    def _leave(self) -> None:
        context = self.spark._jsc and self.spark._jsc.sc()
        if context and not context.isStopped():
            delete(self.spark, self.root)
