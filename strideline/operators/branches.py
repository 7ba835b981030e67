"""Branches: assignment to known centres, discovery, summaries and the tables made of them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideline.functions.geometry import circular_mean, length
from strideline.operators import clustering
from strideline.operators.decisions import KEYS, NO_BRANCH, NO_ENTRY, decided, scan
from strideline.operators.ranks import ranked
from strideline.plans.params import Decision, Junction
from strideline.sources.scratch import settled


def centers_table(spark: SparkSession, at: dict[int, Sequence[Sequence[float]]]) -> DataFrame:
    """junction, branch, ux, uz from lists of unit vectors, as literals whose size Spark knows when it chooses joins."""
    rows = [F.struct(F.lit(j).alias("junction"), F.lit(k).alias("branch"), F.lit(float(u[0])).alias("ux"), F.lit(float(u[1])).alias("uz")) for j, vs in at.items() for k, u in enumerate(vs)]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.createDataFrame([], "junction int, branch int, ux double, uz double")


def assign(vectors: DataFrame, centers: DataFrame, angle_eps: float = 15.0) -> DataFrame:
    """trajectory, junction, branch, best_dot, second_branch, second_dot: the centre nearest in angle, of directions().

    -2: never entered; -1: no direction, no centre, or none within angle_eps degrees. Of equal centres the lower branch.
    """
    return with_branch(vectors, centers, angle_eps).select(*KEYS, "branch", "best_dot", "second_branch", "second_dot")


def with_branch(vectors: DataFrame, centers: DataFrame, angle_eps: float = 15.0) -> DataFrame:
    """vectors (with entered, vx and vz) beside assign()'s branch, best_dot, second_branch, second_dot. A junction's centres, which are few, are one row, so that vectors keep theirs."""
    some = centers.groupBy(F.col("junction").alias("_of")).agg(F.collect_list(F.struct("branch", "ux", "uz")).alias("_centers"))
    both = vectors.join(some, F.col("junction") == F.col("_of"), "left")
    dots = F.transform("_centers", lambda c: F.struct((F.col("vx") * c["ux"] + F.col("vz") * c["uz"]).alias("dot"), (-c["branch"]).alias("turn")))
    both = both.withColumn("_best", F.slice(F.sort_array(F.filter(dots, lambda d: d["dot"].isNotNull()), asc=False), 1, 2))
    best, second = F.get("_best", F.lit(0)), F.get("_best", F.lit(1))
    branch = F.when(~F.col("entered"), NO_ENTRY).when(best["dot"] >= math.cos(math.radians(angle_eps)), -best["turn"]).otherwise(NO_BRANCH)
    return both.withColumns({"branch": branch.cast("int"), "best_dot": best["dot"], "second_branch": F.coalesce(-second["turn"], F.lit(-1)).cast("int"), "second_dot": second["dot"]}).drop("_of", "_centers", "_best")


def summary(assignments: DataFrame, *, every: bool = False) -> DataFrame:
    """junction, branch, count, percent over branches 0 and up, or over every label."""
    some = assignments if every else assignments.where("branch >= 0")
    counts = some.groupBy("junction", "branch").agg(F.count("*").alias("count"))
    return counts.withColumn("percent", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("junction")))


def entropy(summaries: DataFrame) -> DataFrame:
    """junction, entropy: Shannon entropy in nats of the branches' shares; no rows give none."""
    p = F.col("percent") / 100.0
    return summaries.where("percent > 0").groupBy("junction").agg((-F.sum(p * F.log(p))).alias("entropy"))


def summary_with_entropy(summaries: DataFrame) -> DataFrame:
    """summaries with branch as text and one more row for each junction: 'entropy' and its value in percent."""
    more = entropy(summaries).select("junction", F.lit("entropy").alias("branch"), F.lit(None).cast("long").alias("count"), F.col("entropy").alias("percent"))
    return summaries.select("junction", F.col("branch").cast("string").alias("branch"), "count", "percent").unionByName(more)


def split_small(assignments: DataFrame, min_frac: float = 0.05, least: int = 1, *, outlier_min: int | None = None) -> DataFrame:
    """assignments with is_small and main_branch: branches under max(least, ceil(min_frac * n)) members are small, the others are numbered anew from 0 in order.

    n counts the branches 0 and up of the junction; the codes below 0 keep their value and are never small. Where a
    junction has such a branch, those under outlier_min members are small too.
    """
    whole = Window.partitionBy("junction")
    n, size = F.count(F.when(F.col("branch") >= 0, 1)).over(whole), F.count("*").over(Window.partitionBy("junction", "branch"))
    flagged = assignments.withColumns({"_size": size, "is_small": (F.col("branch") >= 0) & (size < F.greatest(F.lit(least), F.ceil(n * min_frac)))})
    if outlier_min is not None:
        some = F.max(F.col("is_small").cast("int")).over(whole) == 1
        flagged = flagged.withColumn("is_small", F.col("is_small") | (some & (F.col("branch") >= 0) & (F.col("_size") < outlier_min)))
    main = F.when(~F.col("is_small") & (F.col("branch") >= 0), F.col("branch"))
    order = F.dense_rank().over(Window.partitionBy("junction").orderBy(main.asc_nulls_last()))
    return flagged.withColumn("main_branch", F.when(main.isNotNull(), order - 1).when(F.col("branch") < 0, F.col("branch")).cast("int")).drop("_size")


def status_counts(assignments: DataFrame, trajectories: DataFrame) -> DataFrame:
    """junction, status, n over all trajectories: branch k, no decision (-1), no entry (-2) or unassigned."""
    junctions = F.broadcast(assignments.select("junction").distinct())
    every = trajectories.select("trajectory").distinct().crossJoin(junctions).join(assignments, list(KEYS), "left")
    status = F.when(F.col("branch") >= 0, F.concat(F.lit("branch "), F.col("branch").cast("string"))).when(F.col("branch") == NO_BRANCH, "no decision").when(F.col("branch") == NO_ENTRY, "no entry").otherwise("unassigned")
    return every.groupBy("junction", status.alias("status")).agg(F.count("*").alias("n"))


def chain(assignments: DataFrame, junctions: Sequence[int]) -> DataFrame:
    """trajectory, branch_j0, branch_j1, ...: a row for each trajectory."""
    cells = [F.max(F.when(F.col("junction") == j, F.col("branch"))).alias(f"branch_j{k}") for k, j in enumerate(junctions)]
    return assignments.groupBy("trajectory").agg(*cells)


@dataclass(frozen=True)
class Discovery:
    """What a density discovery found, and what later points need to go on from it without the earlier ones: vectors, a row for each trajectory and junction, and cells, the clusters' summary."""

    assigned: DataFrame
    centers: DataFrame
    decided: DataFrame
    vectors: DataFrame
    cells: DataFrame


def _discovered(found: DataFrame, vectors: DataFrame, cells: DataFrame, eps: float, min_samples: int) -> Discovery:
    labels, centers = clustering.clusters(cells, eps=eps, min_samples=min_samples)
    assigned = clustering.labelled(vectors, labels).select(*KEYS, _code().alias("branch"))
    return Discovery(assigned, centers.drop("rank"), found, vectors, cells)


def _code() -> Column:
    return F.when(F.col("branch") >= 0, F.col("branch")).otherwise(F.when(~F.col("entered"), NO_ENTRY).otherwise(NO_BRANCH)).cast("int")


def discovery(points: DataFrame, at: Sequence[Junction], how: Decision = Decision(), *, eps: float = 15.0, min_samples: int = 5) -> Discovery:
    """The branches of all junctions by density, at any size: assignments (with -1 and -2), centres and decision points."""
    found = settled(clustering.celled(decided(scan(points, at, how.checked(at)), how), eps), "directions")
    return _discovered(found.drop("entered", "usable", "vx", "vz", "angle", "cell"), found, clustering.summary(found, min_samples), eps, min_samples)


def discover(points: DataFrame, at: Sequence[Junction], how: Decision = Decision(), *, method: str = "dbscan", k: int = 3, k_range: tuple[int, int] = (2, 6), seed: int | dict[int, int] = 0, eps: float = 15.0, min_samples: int = 5, min_separation: float = 12.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assignments (with -1 and -2), centres and decision points of all junctions in one pass.

    Directions are clustered junction by junction: 'dbscan' by density, 'kmeans' into k clusters, 'auto' into as many of
    k_range as give the best silhouette; all three at any size.
    """
    if method == "dbscan":
        d = discovery(points, at, how, eps=eps, min_samples=min_samples)
        return d.assigned, d.centers, d.decided
    if method not in ("kmeans", "auto"):
        raise ValueError("method must be dbscan, kmeans or auto")
    found = settled(decided(scan(points, at, how.checked(at)), how), "directions")
    labels = clustering.kmeans(found.where("usable"), k=k, k_range=k_range if method == "auto" else None, seed=seed, min_separation=min_separation)
    labels, centers = clustering.by_angle(labels)
    labels = found.select(*KEYS, "entered").join(labels.select(*KEYS, "branch"), list(KEYS), "left")
    return labels.select(*KEYS, _code().alias("branch")), centers, found.drop("entered", "usable", "vx", "vz")


def discover_chain(points: DataFrame, at: Sequence[Junction], how: Decision = Decision(), *, seed: int = 0, **settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A chain table (trajectory, branch_j0, branch_j1, ... in the order of the junctions) of discovered branches, the centres and the decision points. A junction's seed is that of its place, counted from seed."""
    assigned, centers, spots = discover(points, at, how, seed={j.junction: seed + k for k, j in enumerate(at)}, **settings)
    return chain(assigned, [j.junction for j in at]), centers, spots


def rediscover(points: DataFrame, known: Discovery, at: Sequence[Junction], assigned: DataFrame, how: Decision, *, eps: float = 15.0, min_samples: int = 5) -> Discovery | None:
    """The discovery of the known points and new ones together, if the new ones that fit no centre (-1 in assigned) form a cluster of their own; else None.

    The summary of the known directions' cells and that of the new ones make the summary of both, from which the
    clusters follow; the known points are not read again. eps and min_samples have to be those of the known discovery.
    """
    found = settled(clustering.celled(decided(scan(points, at, how.checked(at)), how), eps), "directions")
    lost = found.where("usable").join(assigned.where(f"branch = {NO_BRANCH}").select(*KEYS), list(KEYS), "left_semi")
    if clustering.clusters(clustering.summary(lost, min_samples), eps=eps, min_samples=min_samples)[1].isEmpty():
        return None
    cells = settled(clustering.merged(known.cells, clustering.summary(found, min_samples), min_samples), "cells")
    vectors = known.vectors.unionByName(found)
    return _discovered(vectors.drop("entered", "usable", "vx", "vz", "angle", "cell"), vectors, cells, eps, min_samples)


def numbered(assignments: DataFrame) -> DataFrame:
    """trajectory, number: trajectory ids that are whole numbers, numbered from 0 in their order. Other ids have none."""
    ids = assignments.select("trajectory", F.col("trajectory").try_cast("long").alias("_id")).where("_id is not null").distinct()
    return ranked(ids, "_id", "trajectory", as_="number").select("trajectory", "number")


def normalized(chains: DataFrame, decisions: DataFrame | None = None, junction: int | None = 0, *, junctions: Sequence[int] | None = None, known: DataFrame | None = None, outliers: bool = False, strict: bool = False, least: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Assignments for later analysis, and a report: input_rows, kept, dropped, has_decisions.

    The rows are those of a chain table (branch_j0, ... of the given junctions; a plain branch column counts as the
    junction's) whose trajectory is among known (all, without it), and unless outliers is set have a branch of 0 or more
    at every one of the junctions. decisions adds decision_idx, intercept_x and intercept_z, of the junction or of all.
    strict raises when fewer than a share of least of the rows is known.
    """
    junctions = [junction or 0] if junctions is None else list(junctions)
    rows = chains
    if len(junctions) == 1 and f"branch_j{junctions[0]}" not in rows.columns:
        rows = rows.withColumn(f"branch_j{junctions[0]}", F.col("branch") if "branch" in rows.columns else F.lit(None).cast("int"))
    kept = rows if known is None else rows.join(known.select("trajectory").distinct(), "trajectory", "left_semi")
    report = rows.agg(F.count("*").alias("input_rows")).crossJoin(kept.agg(F.count("*").alias("kept")))  # a row each
    report = report.select("input_rows", "kept", (F.col("input_rows") - F.col("kept")).alias("dropped"), F.lit(decisions is not None).alias("has_decisions"))
    if strict:
        said = report.first()
        if said["kept"] < least * max(1, said["input_rows"]):
            raise ValueError(f"{said['kept']} of {said['input_rows']} rows have a known trajectory")
    out = kept
    if decisions is not None:
        some = decisions if junction is None else decisions.where(F.col("junction") == junction)
        out = out.join(some.select("trajectory", "decision_idx", "intercept_x", "intercept_z"), "trajectory", "left")
    for j in [] if outliers else junctions:
        if f"branch_j{j}" in out.columns:
            out = out.where(F.col(f"branch_j{j}") >= 0)
    return out, report


def inconsistencies(assignments: DataFrame) -> DataFrame:
    """trajectory, junction, n of the keys that occur more than once."""
    return assignments.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1")


def missing_columns(chains: DataFrame, junctions: Sequence[int]) -> list[str]:
    """The columns branch_j0, ... of the junctions that a chain table lacks; for one junction a plain branch column will do."""
    if len(junctions) == 1 and "branch" in chains.columns:
        return []
    return [c for c in (f"branch_j{j}" for j in junctions) if c not in chains.columns]


def branch_directions(assignments: DataFrame, points: DataFrame, at: DataFrame, centers: DataFrame | None = None) -> DataFrame:
    """junction, branch, ux, uz, turn: the mean direction of each branch's decision points, and its place in their order by angle.

    With centers (junction, branch, ux, uz), a branch of theirs without decision points has its centre's direction.
    """
    both = assignments.where("branch >= 0").join(points.where("decision_idx is not null"), list(KEYS)).join(at.select("junction", "cx", "cz"), "junction")
    dx, dz = F.col("intercept_x") - F.col("cx"), F.col("intercept_z") - F.col("cz")
    g = both.groupBy("junction", "branch").agg(F.avg(dx).alias("mx"), F.avg(dz).alias("mz"), circular_mean(F.atan2(dx, dz)).alias("mean_yaw"))
    size = length(F.col("mx"), F.col("mz"))
    g = g.select("junction", "branch", (F.col("mx") / F.when(size > 0, size)).alias("ux"), (F.col("mz") / F.when(size > 0, size)).alias("uz"), "mean_yaw")
    if centers is not None:
        own = centers.select("junction", "branch", F.col("ux").alias("_ux"), F.col("uz").alias("_uz"))
        none = F.col("mean_yaw").isNull()
        pick = lambda c: F.when(none, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        g = g.join(own, ["junction", "branch"], "full").select("junction", "branch", pick("ux"), pick("uz"), F.when(none, F.atan2("_ux", "_uz")).otherwise(F.col("mean_yaw")).alias("mean_yaw"))
    turn = F.row_number().over(Window.partitionBy("junction").orderBy("mean_yaw", "branch")) - 1
    return g.select("junction", "branch", "ux", "uz", turn.alias("turn"))
