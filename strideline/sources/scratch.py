"""Tables that are written once in the shared folder and read several times."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    A local session without either, as in tests, gets a temporary folder of its own; a cluster's has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='strideline-')}")
    return found.rstrip("/")


def _app_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/strideline-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{_app_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for scope in getattr(_made, "scopes", ()):
        scope.paths.append(path)
    return path


def settled(df: DataFrame, label: str) -> DataFrame:
    """df, written to this application's part of the shared folder and read back: what made it runs once, and lost executors cost nothing written."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of scratch_path() through Hadoop's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application has settled; results not yet written elsewhere can't be read after that."""
    remove(spark, _app_dir(spark))


class Scratch:
    """The scratch paths that a with block of this thread takes; drop() deletes them, once what was made of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _made.scopes = [*getattr(_made, "scopes", ()), self]
        return self

    def __exit__(self, *_) -> None:
        _made.scopes = [s for s in _made.scopes if s is not self]

    def drop(self, keep: str = "") -> None:
        for path in self.paths:
            if path != keep:
                remove(self.spark, path)
        self.paths = [p for p in self.paths if p == keep]
