"""What the corpus operators share: tables written in the shared folder, batches of texts, and what workers remember."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.sources.scratch import Scratch, clear_scratch, remove, scratch_path, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and lost executors cost nothing written."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ascii_lower(c: Column | str) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


#: Bytes of an Arrow batch of texts (one text at least).
BATCH_BYTES = 8 << 20


def map_texts(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of BATCH_BYTES at most: a task's JVM and its Python worker each hold a whole batch beside what the executor keeps.

    Spark reads the bound when the DataFrame is run, so it is set for the session, if it is not lower there. It cuts
    batches and changes no result.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(conf.get(key).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


class Memory:
    """A bounded dictionary of two generations: turn() forgets what was not looked up since the one before."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def recall(self, key):
        found = self.before.get(key)
        if found is not None:
            self.now[key] = found
        return found

    def turn(self) -> None:
        if len(self.now) > self.most // 2:
            self.before, self.now = self.now, {}


_held: dict = {}


def _give_back() -> None:
    """Returns freed memory to the system, where the C library can: allocators keep it, and workers of several operators share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held(key, make):
    """make(), which a Python worker keeps from task to task until a task asks for another key: workers are reused, and what the operator before remembered must not stay beside this one's."""
    if key not in _held:
        _held.clear()
        _give_back()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Frees what held() keeps, for tasks that keep nothing themselves."""
    if _held:
        _held.clear()
        _give_back()
