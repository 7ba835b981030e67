"""Places in a global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.sources.scratch import settled


def ranked(rows: DataFrame, *order: str, as_: str = "place") -> DataFrame:
    """rows with their places from 0 in the order of some columns (nulls first); rows that tie in all of them take any order among themselves.

    The rows are dealt by ranges of the order, whose ends Spark samples, so far-off values cost nothing; a row's place is
    its place in its range after the sizes of the ranges before, one number for each task.
    """
    count = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = rows.repartitionByRange(count, *order, F.xxhash64(*rows.columns)).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = settled(sorted_, "ranked")
    part: Column = F.shiftright("_m", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each task
    starts = [0]
    for r in sizes:
        starts.append(starts[-1] + r["n"])
    base = rows.sparkSession.createDataFrame([(r["part"], s) for r, s in zip(sizes, starts)], "_part long, _before long")
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(base), part == F.col("_part")).withColumn(as_, F.col("_before") + within).select(*rows.columns, as_)
