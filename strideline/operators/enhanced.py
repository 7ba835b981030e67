"""Bottlenecks, risk and efficiency of junctions from branch assignments. The thresholds are fixed values.

Every function takes a row for each trajectory and junction with a branch (below 0: none), or the profile() of such rows,
which is one row for each junction. A junction whose rows have no branch of 0 or more counts as one without routes; one
without any row does not exist here, but in the overall values if it is listed.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.sources.scratch import settled

#: Shares from which a branch is a bottleneck and a severe one.
NARROW, SEVERE = 0.6, 0.8


def profile(assignments: DataFrame) -> DataFrame:
    """junction, total, routes, top_share, entropy (bits), evenness (entropy over its most; 0 for one route or none), flow (branch to count; a junction has few branches). A profile is returned as it is."""
    if "evenness" in assignments.columns:
        return assignments
    counts = assignments.groupBy("junction", "branch").agg(F.count("*").alias("n"))
    n = F.when(F.col("branch") >= 0, F.col("n"))
    g = counts.groupBy("junction").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.count(n).alias("routes"), F.max(n).alias("top"), F.sum(n * F.log2(n)).alias("weighted"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(n.isNotNull(), F.struct("branch", "n"))))).alias("flow"),
    )
    total, many = F.when(F.col("total") > 0, F.col("total")), F.when(F.col("routes") > 1, F.col("routes"))
    entropy = F.when(many.isNotNull(), F.log2(total) - F.col("weighted") / total).otherwise(0.0)
    return g.select("junction", "total", "routes", (F.col("top") / total).alias("top_share"), entropy.alias("entropy"), F.coalesce(entropy / F.log2(many), F.lit(0.0)).alias("evenness"), "flow")


def bottlenecks(assignments: DataFrame, *, narrow: float = NARROW, severe: float = SEVERE) -> DataFrame:
    """junction, branch, n, share, severity of branches that over a share of narrow (MEDIUM) or severe (HIGH) of a junction's trajectories take."""
    at = profile(assignments).select("junction", "total", F.explode("flow").alias("branch", "n"))
    share = at.select("junction", "branch", "n", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") > narrow)
    return share.withColumn("severity", F.when(F.col("share") > severe, "HIGH").otherwise("MEDIUM"))


def balanced(assignments: DataFrame, *, least: float = 0.7) -> DataFrame:
    """junction, evenness, entropy, routes of junctions with several routes that are used evenly (over least)."""
    return profile(assignments).where((F.col("evenness") > least) & (F.col("routes") > 1)).select("junction", "evenness", "entropy", "routes")


def flow_analysis(assignments: DataFrame) -> DataFrame:
    """junction, total, entropy (bits; 0 for one route or none) and flow, a map of branches to counts."""
    return profile(assignments).select("junction", "total", "entropy", "flow")


def risk(assignments: DataFrame, *, least: float = 0.0) -> DataFrame:
    """junction, risk, level, concentration, diversity, crowding, top_share, routes, total.

    A third each of concentration (a share over 0.7, by 0.3), lack of routes (1 for one or none, 0.3 for two) and
    crowding (trajectories over 50, by 50, at most 1). HIGH from 0.7, MEDIUM from 0.4. Reports usually start at 0.4 (least).
    """
    top, n = F.col("top_share"), F.col("total")
    p = profile(assignments).withColumns({
        "concentration": F.when(top > 0.7, (top - 0.7) / 0.3).otherwise(0.0),
        "diversity": F.when(F.col("routes") < 2, 1.0).when(F.col("routes") == 2, 0.3).otherwise(0.0),
        "crowding": F.when(n > 100, 1.0).when(n > 50, (n - 50) / 50.0).otherwise(0.0),
    })
    p = p.withColumn("risk", F.least((F.col("concentration") + F.col("diversity") + F.col("crowding")) / 3.0, F.lit(1.0)))
    level = F.when(F.col("risk") >= 0.7, "HIGH").when(F.col("risk") >= 0.4, "MEDIUM").otherwise("LOW")
    return p.where(F.col("risk") >= least).select("junction", "risk", level.alias("level"), "concentration", "diversity", "crowding", "top_share", "routes", "total")


def _mean(found: DataFrame, column: str, name: str, junctions: Sequence[int] | None) -> DataFrame:
    """The mean over the junctions that have rows, or over all that are listed, of which those without count as 0."""
    if junctions is None:
        return found.agg(F.avg(column).alias(name))
    some = found.where(F.col("junction").isin(list(junctions)))
    return some.agg((F.coalesce(F.sum(column), F.lit(0.0)) / F.lit(max(1, len(junctions)))).alias(name))


def overall_risk(assignments: DataFrame, junctions: Sequence[int] | None = None) -> DataFrame:
    """risk: the mean over all junctions with rows, or all listed ones."""
    return _mean(risk(assignments), "risk", "risk", junctions)


def efficiency(assignments: DataFrame) -> DataFrame:
    """junction, route_efficiency (the evenness of its routes), capacity (trajectories in hundreds, at most 1)."""
    return profile(assignments).select("junction", F.col("evenness").alias("route_efficiency"), F.least(F.col("total") / 100.0, F.lit(1.0)).alias("capacity"))


def overall_efficiency(assignments: DataFrame, junctions: Sequence[int] | None = None) -> DataFrame:
    """efficiency: the mean route efficiency over all junctions with rows, or all listed ones."""
    return _mean(efficiency(assignments), "route_efficiency", "efficiency", junctions)


def recommendations(assignments: DataFrame, *, narrow: float = NARROW, severe: float = SEVERE, even: float = 0.7) -> DataFrame:
    """type, priority, junction, message.

    Each severe bottleneck asks for signage and for another route, each balanced junction for none; when there are more
    bottlenecks than half of the junctions, one row with junction ALL asks for a review of the whole.
    """
    found = bottlenecks(assignments, narrow=narrow, severe=severe)
    at = F.col("junction").cast("string")
    # The messages.
    sign = F.format_string("Add directional signage at Junction %d to distribute traffic away from Branch %d (currently %.1f%% of traffic)", "junction", "branch", F.col("share") * 100)
    widen = F.format_string("Consider widening or adding alternative routes at Junction %d to reduce bottleneck risk", "junction")
    advice = F.explode(F.array(F.struct(F.lit("Signage").alias("type"), sign.alias("message")), F.struct(F.lit("Route Modification").alias("type"), widen.alias("message"))))
    high = found.where("severity = 'HIGH'").select(advice.alias("a"), at.alias("junction")).select("a.type", F.lit("HIGH").alias("priority"), "junction", "a.message")
    keep = F.format_string("Junction %d shows good traffic distribution (balance ratio: %.2f) - maintain current design", "junction", "evenness")
    low = balanced(assignments, least=even).select(F.lit("Maintenance").alias("type"), F.lit("LOW").alias("priority"), at.alias("junction"), keep.alias("message"))
    both = found.agg(F.count("*").alias("narrow")).crossJoin(assignments.agg(F.countDistinct("junction").alias("all")))  # a row each
    text = "High number of bottlenecks detected - consider system-wide evacuation route optimization"
    whole = both.where("narrow > all * 0.5").select(F.lit("System-wide").alias("type"), F.lit("MEDIUM").alias("priority"), F.lit("ALL").alias("junction"), F.lit(text).alias("message"))
    return high.unionByName(low).unionByName(whole)


def overview(assignments: DataFrame, *, junctions: Sequence[int] | None = None, at: datetime.datetime | None = None) -> DataFrame:
    """overall_risk, bottlenecks, balanced, recommendations, at_risk (from 0.4), and analysed_at (now, or at). The profile is made once."""
    assignments = settled(profile(assignments), "profile")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    rows = overall_risk(assignments, junctions).withColumnRenamed("risk", "overall_risk")
    for df, name in ((bottlenecks(assignments), "bottlenecks"), (balanced(assignments), "balanced"), (recommendations(assignments), "recommendations"), (risk(assignments, least=0.4), "at_risk")):
        rows = rows.crossJoin(count(df, name))  # a row each
    return rows.withColumn("analysed_at", F.current_timestamp() if at is None else F.lit(at))
