"""Streams of points: visits as they happen, and entries per window of event time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strideline.operators.flows import node_of
from strideline.plans.params import Junction


def live_visits(points: DataFrame, at: Sequence[Junction], *, time: str = "ts", lateness: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """trajectory, visit, junction, previous, ts of each new visit in a stream of points (trajectory, ts, x, z).

    A trajectory's state is its last node, last junction and number of visits; it ends when no point came for idle_ms
    of event time. Points of one batch are taken in time order; later ones that are older than the state are ignored.
    """
    nodes = points.withWatermark(time, lateness).select("trajectory", F.col(time).alias("ts"), node_of(at).alias("junction"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        node, last, n, seen = state.get if state.exists else (-1, -1, 0, pd.Timestamp(0).value)
        out = []
        for r in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples():
            if r.ts.value < seen:
                continue
            here, seen = -1 if pd.isna(r.junction) else int(r.junction), r.ts.value
            if here >= 0 and here != node:
                out.append((key[0], n, here, None if last < 0 else last, r.ts))
                last, n = here, n + 1
            node = here
        state.update((node, last, n, seen))
        state.setTimeoutTimestamp(max(seen // 1_000_000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["trajectory", "visit", "junction", "previous", "ts"]).astype({"previous": "Int32"})

    return nodes.groupBy("trajectory").applyInPandasWithState(step, "trajectory string, visit int, junction int, previous int, ts timestamp", "node int, last int, n int, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def entries_per_window(points: DataFrame, at: Sequence[Junction], *, time: str = "ts", width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """begin, junction, points, trajectories (approximate) in each window of event time; points later than lateness are dropped."""
    inside = points.withWatermark(time, lateness).withColumn("junction", node_of(at)).where("junction is not null")
    g = inside.groupBy(F.window(time, width).alias("w"), "junction").agg(F.count("*").alias("points"), F.approx_count_distinct("trajectory").alias("trajectories"))
    return g.select(F.col("w.start").alias("begin"), "junction", "points", "trajectories")
