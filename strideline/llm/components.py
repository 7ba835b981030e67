"""Connected components by alternating large-star and small-star rounds, in DataFrame operations only.

Each round writes its tables to the shared folder. A hub's neighbours meet its minimum in a sort-merge join of two
freshly exchanged tables, which adaptive execution splits when a hub holds a large share of all edges; everything else
is a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import materialize, remove


def _star(edges: DataFrame, large: bool, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """One star step over edges (hi, lo): every node's neighbours are linked to the least of them."""
    turned = edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))
    both = edges.union(turned) if large else edges
    least, path = materialize(both.groupBy("hi").agg(F.least("hi", F.min("lo")).alias("least")), "least")
    scratch.append(path)
    joined = both.join(least, "hi")
    if large:
        linked = joined.where("lo > hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    else:
        linked = joined.where("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        linked = linked.union(least.select("hi", F.col("least").alias("lo")))
    out, path = materialize(linked.where("hi > lo").distinct(), "star")
    scratch.append(path)
    return out, least


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node it reaches) for every node of an undirected edge table; nodes of any orderable type.

    Null ends and self-loops add nothing; repeated edges count once; an empty table gives an empty table. The rounds
    needed grow with the logarithm of the component size.
    """
    spark, scratch = edges.sparkSession, []
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, path = materialize(pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    scratch.append(path)
    seen = _mark(now)
    while seen[0]:
        used = list(scratch)
        wide, _ = _star(now, True, scratch)
        now, _ = _star(wide, False, scratch)
        for path in used:
            remove(spark, path)
            scratch.remove(path)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo")).distinct()
