"""Where and in which direction a walker leaves a junction.

Steps are taken once per trajectory. What a decision is made of, the same facts for each trajectory and junction, comes
from them in one of two ways, each with the one shuffle by trajectory that the steps need:

* scan() reads the sorted points once and makes no row for a point and junction; it is for what needs these facts alone.
* frame() has a row for each point and (broadcast) junction, with windows and aggregates on (trajectory, junction). It is
  for operators that look at the points themselves; per_pair() takes the facts from it, beside any other aggregates.

Operators here take either. Tests hold the two ways against each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strideline.functions.geometry import distance, length
from strideline.operators.scan import INDICES, LATE, POINT, VALUES, WALK, sweep
from strideline.plans.params import Decision, Junction

#: Junctions that a frame joins by broadcast at most; scan() takes any number.
MOST_JUNCTIONS = 10_000
KEYS = ("trajectory", "junction")
#: Branch codes beside the branches 0, 1, ...
NO_BRANCH, NO_ENTRY = -1, -2


def junction_table(spark: SparkSession, at: Sequence[Junction]) -> DataFrame:
    """junction, cx, cz, r, ring (the outer radius that applies) and reach (the radius that a visit takes)."""
    if len(at) > MOST_JUNCTIONS:
        raise ValueError(f"more than {MOST_JUNCTIONS} junctions")
    names = ("cx", "cz", "r", "ring", "reach")
    rows = [F.struct(F.lit(j.junction).alias("junction"), *[F.lit(float(getattr(j, n))).alias(n) for n in names]) for j in at]
    if len(rows) > 100:  # too many for one expression
        return spark.createDataFrame([(j.junction, *[float(getattr(j, n)) for n in names]) for j in at], "junction int, cx double, cz double, r double, ring double, reach double")
    return spark.range(1).select(F.inline(F.array(*rows)))


def with_steps(points: DataFrame) -> DataFrame:
    """points with dx, dz and seg (the step that ends at the point; null for the first), n, the trajectory's points, and total, its length."""
    w = Window.partitionBy("trajectory").orderBy("idx")
    whole = Window.partitionBy("trajectory")
    d = points.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dz": F.col("z") - F.lag("z").over(w), "n": F.count("*").over(whole)})
    d = d.withColumn("seg", length(F.col("dx"), F.col("dz")))
    return d.withColumn("total", F.coalesce(F.sum("seg").over(whole), F.lit(0.0)))


def scan(points: DataFrame, at: Sequence[Junction], how: Decision = Decision(), *, path_length: Column | None = None, ring: Column | None = None) -> DataFrame:
    """A row for each trajectory and junction with the facts of per_pair(), from one pass over the points; parameters as for frame().

    idx counts each trajectory's points from 0 without gaps, else it is an error. The median step, from Spark's aggregate, holds a trajectory's different steps; all else is carried from batch to batch.
    """
    steps = with_steps(points)
    whole = Window.partitionBy("trajectory")
    none = F.lit(None).cast("double")
    steps = steps.withColumns({
        "timed": F.count("t").over(whole),
        "median": F.percentile("seg", 0.5).over(whole),
        "far": F.lit(float(how.path_length)) if path_length is None else path_length.cast("double"),
        "wide": none if ring is None else ring.cast("double"),
    })
    whole_numbers = ("idx", "n", "timed")
    rows = steps.select("trajectory", *[F.col(c).cast("long" if c in whole_numbers else "double").alias(c) for c in (*POINT, *WALK)]).sortWithinPartitions("trajectory", "idx")
    kind = {"junction": "int", "n": "long", "timed": "long", **dict.fromkeys(INDICES, "long")}
    key = points.schema["trajectory"].dataType
    names = ["trajectory", "junction", "cx", "cz", "r", "ring", "reach", "n", "total", "timed", "median", *INDICES, *VALUES]
    schema = ", ".join(f"{n} {key.simpleString() if n == 'trajectory' else kind.get(n, 'double')}" for n in names)
    found = rows.mapInArrow(sweep(at, how, to_arrow_type(key), names), schema)
    idx = points.schema["idx"].dataType
    return found.withColumns({**{n: F.col(n).cast(idx) for n in INDICES}, "entered": F.col("first_in").isNotNull()})


def per_pair(rows: DataFrame, how: Decision = Decision(), *more: Column, approx: bool = False) -> DataFrame:
    """trajectory, junction and what their decision is made of, by one aggregation of a frame; more aggregates go along. A scan() is returned as it is.

    The indices of frame() and ring_in and reach_in, the first points within the outer radii; x, z, dist, t and path at
    them; and the sums and steps that directions are made of. approx takes the median by approximation.
    """
    if "idx" not in rows.columns:
        return rows
    idx, seg, start = F.col("idx"), F.col("seg"), F.col("start")
    pick = lambda c, index, by=0: F.max(F.when(idx == F.col(f"{index}_idx") - by, F.col(c)))
    step = F.struct(seg, (-idx).alias("turn"), "dx", "dz", "prev_dist")
    clear = F.col("prev_dist") >= F.col("r") + max(5.0, how.linger_delta)
    near = (idx > F.greatest(start, F.col("radial_idx") - how.window)) & (idx <= F.col("radial_idx"))
    big, late = seg >= how.epsilon, (idx > start) & (idx > F.col("n") - 1 - LATE)
    total = lambda c, when: F.sum(F.when(when, F.col(c)))
    same = ("n", "total", "cx", "cz", "r", "ring", "reach", "entered", "first_in", "last_in", "nearest", "start", "radial_idx", "trend_idx", "pathlen_idx")
    g = rows.groupBy(*KEYS).agg(
        *[F.first(c).alias(c) for c in same],
        F.count("t").alias("timed"),
        (F.percentile_approx("seg", 0.5) if approx else F.percentile("seg", 0.5)).alias("median"),  # of one trajectory
        F.min(F.when(F.col("dist") <= F.col("ring"), idx)).alias("ring_in"), F.min(F.when(F.col("dist") <= F.col("reach"), idx)).alias("reach_in"),
        F.max(F.when(idx == start, F.col("t"))).alias("t_start"), pick("t", "pathlen", 1).alias("t_before_pathlen"),
        *[pick("t", k).alias(f"t_{k}") for k in ("radial", "trend", "pathlen")], *[pick("path", k).alias(f"path_{k}") for k in ("trend", "pathlen")],
        *[pick(c, k).alias(f"{k}_{c}") for k in ("radial", "pathlen") for c in ("x", "z", "dist")],
        total("dx", near & big).alias("rx"), total("dz", near & big).alias("rz"), F.max(F.when(near, step)).alias("_near"),
        F.min(F.when((idx >= F.col("pathlen_idx")) & big & clear, F.struct("idx", "dx", "dz"))).alias("_t1"),
        F.max(F.when(idx > start, step)).alias("_t2"), total("dx", late).alias("lx"), total("dz", late).alias("lz"),
        F.max(F.when((idx == F.col("n") - 1) & (idx > start), F.col("prev_dist"))).alias("end_dist"),
        *more,
    )
    parts = {f"{k}_{c}": F.col(f"_{k}.{c}") for k in ("near", "t1", "t2") for c in ("dx", "dz")}
    return g.withColumns({**parts, "t2_seg": F.col("_t2.seg"), "t2_prev": F.col("_t2.prev_dist")}).drop("_near", "_t1", "_t2")


def frame(points: DataFrame, at: Sequence[Junction], how: Decision = Decision(), *, path_length: Column | None = None, ring: Column | None = None, again_length: Column | None = None, again_ring: Column | None = None) -> DataFrame:
    """A row for each point and junction: steps, dist, entered, start, path (the length since start), and the indices radial_idx, trend_idx (without the one-sample rule) and pathlen_idx.

    start is the first point inside, else the nearest. A point crosses the ring when it is on or beyond it and the
    distance has not fallen over the last samples after start (window of them at most). path_length and ring replace those
    of how and of the junctions by columns, of total (the trajectory's length) for instance; a ring within the radius is r + 10.
    again_idx is pathlen_idx with again_length or radial_idx with again_ring, if one is given.
    """
    spark = points.sparkSession
    both = with_steps(points).crossJoin(F.broadcast(junction_table(spark, at)))
    beyond = lambda c: F.when(c > F.col("r"), c).otherwise(F.col("r") + 10.0)
    if ring is not None:
        both = both.withColumn("ring", beyond(ring))
    far = F.lit(how.path_length) if path_length is None else path_length
    whole = Window.partitionBy(*KEYS)
    inner = whole.orderBy("idx")
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("dist", distance(F.col("x"), F.col("z"), F.col("cx"), F.col("cz")))
    both = both.withColumns({"inside": F.col("dist") <= F.col("r")})
    both = both.withColumns({
        "first_in": F.min(F.when(F.col("inside"), F.col("idx"))).over(whole),
        "last_in": F.max(F.when(F.col("inside"), F.col("idx"))).over(whole),
        "nearest": F.min(F.struct("dist", "idx")).over(whole)["idx"],
        "prev_dist": F.lag("dist").over(inner),
        "far_dist": F.lag("dist", how.window).over(inner),
    })
    both = both.withColumns({"entered": F.col("first_in").isNotNull(), "start": F.coalesce("first_in", "nearest")})
    after = F.col("idx") > F.col("start")
    both = both.withColumns({
        "path": F.sum(F.when(after, F.col("seg"))).over(run),
        "begin_dist": F.max(F.when(F.col("idx") == F.col("start") + 1, F.col("dist"))).over(whole),
    })
    base = F.when(F.col("idx") - how.window >= F.col("start") + 1, F.col("far_dist")).otherwise(F.col("begin_dist"))
    crossing = lambda ring: after & (F.col("dist") >= ring) & (F.col("dist") >= base)
    first = lambda when: F.min(F.when(when, F.col("idx"))).over(whole)
    again = {} if again_length is None else {"again_idx": first(after & (F.col("path") >= again_length))}
    again |= {} if again_ring is None else {"again_idx": first(crossing(beyond(again_ring)))}
    return both.withColumns({
        "radial_idx": first(crossing(F.col("ring"))),
        "trend_idx": first(crossing(F.col("ring")) & (F.col("idx") > F.col("start") + 1)),
        "pathlen_idx": first(after & (F.col("path") >= far)),
        **again,
    })


def decision_index(mode: str, radial: Column | None = None, pathlen: Column | None = None) -> Column:
    radial, pathlen = F.col("radial_idx") if radial is None else radial, F.col("pathlen_idx") if pathlen is None else pathlen
    return {"radial": radial, "pathlen": pathlen, "hybrid": F.coalesce(radial, pathlen)}[mode]


def entries(rows: DataFrame) -> DataFrame:
    """trajectory, junction, entered, start_idx: where each trajectory enters (else comes nearest to) each junction."""
    return per_pair(rows).select(*KEYS, "entered", F.col("start").alias("start_idx"))


def decision_indices(rows: DataFrame, mode: str = "hybrid") -> DataFrame:
    """trajectory, junction, radial_idx, pathlen_idx, decision_idx (null where there is none; one-point trajectories have none)."""
    return per_pair(rows).select(*KEYS, "radial_idx", "pathlen_idx", decision_index(mode).alias("decision_idx"))


def with_directions(pairs: DataFrame, how: Decision) -> DataFrame:
    """per_pair() with usable, vx, vz, mode_used."""
    unit = lambda x, z: F.when(length(x, z) > 0, F.struct((x / F.when(length(x, z) > 0, length(x, z))).alias("vx"), (z / F.when(length(x, z) > 0, length(x, z))).alias("vz")))
    step = lambda k: unit(F.col(f"{k}_dx"), F.col(f"{k}_dz"))
    far = F.col("r") + max(5.0, how.linger_delta)
    radial = F.when(F.col("rx").isNotNull(), unit(F.col("rx"), F.col("rz"))).otherwise(step("near"))
    t2 = F.when((F.col("t2_seg") > 0) & (F.col("t2_prev") >= far), step("t2"))
    t3 = F.when(F.col("end_dist") >= far, unit(F.col("lx"), F.col("lz")))
    pathlen = F.coalesce(step("t1"), t2, t3)
    v = {"radial": radial, "pathlen": pathlen, "hybrid": F.coalesce(radial, pathlen)}[how.mode]
    used = F.when(radial.isNotNull(), "radial").otherwise("pathlen") if how.mode == "hybrid" else F.lit(how.mode)
    found = pairs.withColumns({"_v": v, "_used": used}).withColumn("usable", F.col("entered") & F.col("_v").isNotNull())
    usable = F.col("usable")
    return found.withColumns({"vx": F.when(usable, F.col("_v.vx")), "vz": F.when(usable, F.col("_v.vz")), "mode_used": F.when(usable, F.col("_used"))}).drop("_v", "_used")


def directions(rows: DataFrame, how: Decision) -> DataFrame:
    """trajectory, junction, entered, usable, vx, vz, mode_used: the unit direction in which each junction is left.

    radial: the sum of the steps of epsilon or more in the window up to the crossing, else the longest of them. pathlen: the
    first step of epsilon or more from the path length on that starts clear of the junction, else the longest step if it
    does, else the last ten steps together if the last but one point does. hybrid: radial, else pathlen.
    """
    return with_directions(per_pair(rows, how), how).select(*KEYS, "entered", "usable", "vx", "vz", "mode_used")


def decided(rows: DataFrame, how: Decision, *, approx: bool = False) -> DataFrame:
    """directions() and decision_points() at once: trajectory, junction, entered, usable, vx, vz, mode_used, decision_idx, intercept_x, intercept_z, reason."""
    both = with_directions(per_pair(rows, how, approx=approx), how)
    spot = lambda k: F.when(F.col(f"{k}_idx").isNotNull(), F.struct(F.col(f"{k}_idx").alias("idx"), *[F.col(f"{k}_{c}").alias(c) for c in ("x", "z", "dist")]))
    both = both.withColumn("_at", F.when(F.col("mode_used") == "radial", spot("radial")).when(F.col("mode_used") == "pathlen", spot("pathlen")))
    near = F.coalesce(F.col("_at.dist") <= F.col("ring") + F.greatest(2 * F.coalesce("median", F.lit(0.0)), F.lit(1.0)), F.lit(False))
    reason = F.when(~F.col("entered"), "no_junction_entry").when(~F.col("usable"), "no_vector").when(near, F.col("mode_used")).otherwise("no_decision_point")
    at = F.when(near, F.col("_at"))
    return both.select(*KEYS, "entered", "usable", "vx", "vz", at["idx"].alias("decision_idx"), at["x"].alias("intercept_x"), at["z"].alias("intercept_z"), "mode_used", reason.alias("reason"))


def decision_points(rows: DataFrame, how: Decision, *, approx: bool = False) -> DataFrame:
    """trajectory, junction, decision_idx, intercept_x, intercept_z, mode_used, reason.

    The index is that of the mode a direction came from. Points further out than the ring plus twice the trajectory's
    median step (at least 1) are rejected; reason is the mode, no_junction_entry, no_vector or no_decision_point. approx
    takes the median of a frame by approximation, for trajectories whose different steps do not fit in memory.
    """
    return decided(rows, how, approx=approx).drop("entered", "usable", "vx", "vz")


def diagnostics(points: DataFrame) -> DataFrame:
    """trajectory, junction, used, reason of decision_points(): two rows where a direction was used and its decision point rejected."""
    reason = F.when(F.col("reason") == "no_decision_point", F.array("mode_used", "reason")).otherwise(F.array("reason"))
    each = points.select(*KEYS, F.explode(reason).alias("reason"))
    return each.select(*KEYS, F.col("reason").isin("radial", "pathlen").alias("used"), "reason")


def searched(rows: DataFrame, how: Decision, within: Column | float = 50.0) -> DataFrame:
    """trajectory, junction, decision_idx: the first point within a distance (and epsilon) near the closest approach, else that approach.

    It is looked for up to path_length samples (rounded down), a tenth of the trajectory or 50 samples on each side,
    whichever is least.
    """
    reach = F.least(F.lit(int(how.path_length)), F.floor(F.col("n") / 10), F.lit(50))
    idx, nearest = F.col("idx"), F.col("nearest")
    inside = (idx >= nearest - reach) & (idx < nearest + reach) & (F.col("dist") <= (F.lit(within) if isinstance(within, (int, float)) else within) + how.epsilon)
    g = rows.groupBy(*KEYS).agg(F.min(F.when(inside, idx)).alias("found"), F.first("nearest").alias("nearest"))
    return g.select(*KEYS, F.coalesce("found", "nearest").alias("decision_idx"))


def first_decisions(rows: DataFrame, how: Decision, wide: float = 50.0) -> DataFrame:
    """trajectory, junction, decision_idx: the quick choice of a decision point.

    In radial mode, and in hybrid mode at rings over wide, the first point within the ring, or none; else searched().
    """
    entry = rows.groupBy(*KEYS).agg(F.first("ring").alias("ring"), F.min(F.when(F.col("dist") <= F.col("ring"), F.col("idx"))).alias("decision_idx"))
    if how.mode == "radial":
        return entry.drop("ring")
    if how.mode == "pathlen":
        return searched(rows, how)
    near = searched(rows.where(F.col("ring") <= wide), how)
    return entry.where(F.col("ring") > wide).drop("ring").unionByName(near)


def nearest_points(rows: DataFrame) -> DataFrame:
    """trajectory, junction, decision_idx: the closest approach."""
    return per_pair(rows).select(*KEYS, F.col("nearest").alias("decision_idx"))


def first_within(rows: DataFrame, reach: str = "ring") -> DataFrame:
    """trajectory, junction, decision_idx: the first point within the outer radius ('ring', or 'reach', the radius that a visit takes), else the nearest one."""
    within = F.col(f"{reach}_in")
    return per_pair(rows).select(*KEYS, F.coalesce(within, "nearest").alias("decision_idx"), within.isNotNull().alias("reached"))


def near_ring(rows: DataFrame, window_radius: float, tolerance: float = 5.0) -> DataFrame:
    """trajectory, junction, intercept_x, intercept_z: the first point within tolerance of the outer radius, if it lies in the square about the centre."""
    hit = F.min(F.when(F.abs(F.col("dist") - F.col("ring")) < tolerance, F.struct("idx", "x", "z")))
    g = rows.groupBy(*KEYS, "cx", "cz").agg(hit.alias("hit"))
    seen = F.col("hit.x").between(F.col("cx") - window_radius, F.col("cx") + window_radius) & F.col("hit.z").between(F.col("cz") - window_radius, F.col("cz") + window_radius)
    return g.where(seen).select(*KEYS, F.col("hit.idx").alias("decision_idx"), F.col("hit.x").alias("intercept_x"), F.col("hit.z").alias("intercept_z"))


def clip_to_area(rows: DataFrame, factor: float = 1.5) -> DataFrame:
    """Points within factor outer radii of each junction whose outer radius the trajectory comes within; others are kept whole."""
    came = F.max((F.col("dist") <= F.col("ring")).cast("int")).over(Window.partitionBy(*KEYS)) == 1
    return rows.withColumn("_came", came).where(~F.col("_came") | (F.col("dist") <= factor * F.col("ring"))).drop("_came")


def clip_to_ring(rows: DataFrame) -> DataFrame:
    """Points within the outer radius of each junction; trajectories without any drop out."""
    return rows.where(F.col("dist") <= F.col("ring"))


def clip_to_window(rows: DataFrame, window_radius: float) -> DataFrame:
    """Points in the square of half-size window_radius about each junction's centre."""
    near = lambda c: F.abs(F.col(c) - F.col(f"c{c}")) <= window_radius
    return rows.where(near("x") & near("z"))
