"""Intermediate tables on storage every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` as the session has it.

    Only a local session without that setting gets a temporary folder of its own; on a cluster a
    folder of one machine would lose tables together with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="manyvote-"))
    return context.getCheckpointDir()


class Workspace:
    """Writes tables into a fresh sub-folder of the shared folder and reads them back.

    A table read back has no lineage, so a lost executor costs a re-read and no recomputation, and
    its size on disk is known to the optimiser.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.folder = f"{(root or shared_folder(spark)).rstrip('/')}/manyvote-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        target = self.path(name)
        df.write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of saved tables that nothing reads any more."""
        for table in tables:
            for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
                if folder.startswith(self.folder) or self.folder in folder:
                    self._delete(folder)

    def close(self) -> None:
        """Delete the run's folder, when none of its tables and results is read any more."""
        self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
