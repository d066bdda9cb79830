"""Written intermediate tables: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, the context's own or, in local mode, a new one.

    On a cluster the folder must be named: nothing tells which folders all executors and the driver share.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # the setting can't be changed in a running session, so the new folder is kept in the context
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="marlstone-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


class Stash:
    """Writes frames as Parquet below the shared folder; ``drop`` removes what is no longer read.

    What a lazy result still reads can't be dropped by the operator that returns it: the driver
    removes the rest when it ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/marlstone-{uuid.uuid4().hex}"
        self._n = 0
        path, files = self._hadoop(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stash_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "stash_path", None)
        if path:
            hadoop, files = self._hadoop(path)
            files.delete(hadoop, True)
