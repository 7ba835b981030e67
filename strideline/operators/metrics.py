"""Timing and speed at junctions, and statistics over them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.geometry import direction, in_disc, in_tilted, turn
from strideline.operators.decisions import KEYS, frame, per_pair, with_steps
from strideline.plans.params import Decision, Junction, Zone


def in_zone(zone: Zone, x: Column | None = None, z: Column | None = None) -> Column:
    x, z = F.col("x") if x is None else x, F.col("z") if z is None else z
    if zone.circle:
        cx, cz, r = zone.circle
        return in_disc(x, z, cx, cz, r + zone.tolerance)
    if zone.rectangle:
        return in_tilted(x, z, *zone.rectangle, zone.tilt, zone.tolerance)
    return F.lit(False)


def timing(rows: DataFrame, mode: str = "pathlen") -> DataFrame:
    """trajectory, junction, seconds, mode_used: from start to the decision, of a scan or a frame.

    pathlen counts to the sample before the path length is reached, radial to the crossing, hybrid radial, else pathlen.
    """
    return per_pair(rows).select(*KEYS, *_timing(mode))


def _timing(mode: str) -> list[Column]:
    radial, pathlen = F.col("t_radial") - F.col("t_start"), F.col("t_before_pathlen") - F.col("t_start")
    value = {"radial": radial, "pathlen": pathlen, "hybrid": F.coalesce(radial, pathlen)}[mode]
    used = F.when(radial.isNotNull(), "radial").otherwise("pathlen") if mode == "hybrid" else F.lit(mode)
    return [value.alias("seconds"), used.alias("mode_used")]


def between_regions(points: DataFrame, a: Zone, b: Zone) -> DataFrame:
    """trajectory, t_a, t_b, dt_ab: first times in two regions; the difference only if b is reached after a."""
    return points.groupBy("trajectory").agg(*_region_facts(a, b)).select("trajectory", *_region_times())


def _region_facts(a: Zone, b: Zone) -> list[Column]:
    first = lambda zone: F.min(F.when(in_zone(zone), F.struct("idx", "t")))
    return [first(a).alias("_a"), first(b).alias("_b")]


def _region_times() -> list[Column]:
    return [F.col("_a.t").alias("t_a"), F.col("_b.t").alias("t_b"), F.when(F.col("_b.idx") > F.col("_a.idx"), F.col("_b.t") - F.col("_a.t")).alias("dt_ab")]


def totals(points: DataFrame) -> DataFrame:
    """trajectory, distance, duration, speed of whole trajectories; 0 where there is nothing to measure."""
    steps = with_steps(points)
    return steps.groupBy("trajectory").agg(F.first("total").alias("total"), *_time_facts()).select("trajectory", *_totals())


def _time_facts() -> list[Column]:
    timed = F.when(F.col("t").isNotNull(), F.struct("idx", "t"))
    return [F.min(timed).alias("_first"), F.max(timed).alias("_last")]


def _totals() -> list[Column]:
    d, s = F.col("total"), F.coalesce(F.col("_last.t") - F.col("_first.t"), F.lit(0.0))
    return [d.alias("distance"), s.alias("duration"), F.when((d > 0) & (s > 0), d / F.when(s > 0, s)).otherwise(0.0).alias("speed")]


def turns(steps: DataFrame) -> DataFrame:
    """trajectory, sharpest: the greatest smallest angle (radians) between two steps of with_steps() that follow one another; steps of no length have no direction."""
    w = Window.partitionBy("trajectory").orderBy("idx")
    moved = steps.where("seg > 0").withColumn("_course", direction(F.col("dx"), F.col("dz")))
    bend = F.abs(turn(F.col("_course"), F.lag("_course").over(w)))
    return moved.withColumn("_bend", bend).groupBy("trajectory").agg(F.max("_bend").alias("sharpest"))


def speed_through(rows: DataFrame, mode: str = "pathlen") -> DataFrame:
    """trajectory, junction, speed, status: path over time from start to the decision, or why there is none, of a scan or a frame.

    The crossing of the ring needs two samples after start here.
    """
    return per_pair(rows).select(*KEYS, *_speed_through(mode))


def _speed_through(mode: str, speed: str = "speed", status: str = "status") -> list[Column]:
    trend = F.col("trend_idx").isNotNull()
    pick = lambda c: {"radial": F.col(f"{c}_trend"), "pathlen": F.col(f"{c}_pathlen"), "hybrid": F.when(trend, F.col(f"{c}_trend")).otherwise(F.col(f"{c}_pathlen"))}[mode]
    end = {"radial": F.col("trend_idx"), "pathlen": F.col("pathlen_idx"), "hybrid": F.coalesce("trend_idx", "pathlen_idx")}[mode]
    time = pick("t") - F.col("t_start")
    used = F.when(trend, "radial").otherwise("pathlen") if mode == "hybrid" else F.lit(mode)
    still = F.col("start") == F.col("n") - 1
    none = F.when(still & F.lit(mode == "pathlen"), "no_movement").when(still & F.lit(mode == "hybrid"), "hybrid_no_movement").otherwise(f"{mode}_not_reached")
    said = F.when(F.col("timed") == 0, "no_time_data").when(end.isNull(), none).when(F.coalesce(time, F.lit(0.0)) > 0, used).otherwise(F.concat(used, F.lit("_zero_time")))
    return [F.when(end.isNotNull() & (time > 0), pick("path") / F.when(time > 0, time)).alias(speed), said.alias(status)]


def transit(rows: DataFrame, near: float = 2.0, far: float = 5.0) -> DataFrame:
    """trajectory, junction, entry_speed, exit_speed, average_speed about the time inside (first to last point inside).

    Entry and exit are taken over far to near units of time before and after, from two samples on; all are null with
    fewer than three points or without two different points inside.
    """
    return _timed(rows).groupBy(*KEYS).agg(F.first("n").alias("n"), *_transit_facts(near, far)).select(*KEYS, *_transit())


def _timed(rows: DataFrame) -> DataFrame:
    """A frame with the times of the first and last point inside, and of the point before."""
    whole = Window.partitionBy(*KEYS)
    t_at = lambda c: F.max(F.when(F.col("idx") == F.col(c), F.col("t"))).over(whole)
    return rows.withColumns({"t_in": t_at("first_in"), "t_out": t_at("last_in"), "before": F.lag("t").over(whole.orderBy("idx"))})


def _transit_facts(near: float = 2.0, far: float = 5.0) -> list[Column]:
    idx, t, before = F.col("idx"), F.col("t"), F.col("before")
    early = lambda c: c.between(F.col("t_in") - far, F.col("t_in") - near)
    late = lambda c: c.between(F.col("t_out") + near, F.col("t_out") + far)
    entry, leave = early(t) & (F.col("first_in") > 0), late(t) & (F.col("last_in") < F.col("n") - 1)
    inside = (idx > F.col("first_in")) & (idx <= F.col("last_in"))

    def speed(name: str, of: Column, step: Column) -> list[Column]:
        return [F.sum(F.when(step, F.col("seg"))).alias(f"_{name}_path"), (F.max(F.when(of, t)) - F.min(F.when(of, t))).alias(f"_{name}_time")]

    average = [F.sum(F.when(inside, F.col("seg"))).alias("_average_path"), F.max(F.col("t_out") - F.col("t_in")).alias("_average_time")]
    return [*speed("entry", entry, entry & early(before)), *speed("exit", leave, leave & late(before)), *average, (F.first("last_in") > F.first("first_in")).alias("_through")]


def _transit() -> list[Column]:
    ok = (F.col("n") >= 3) & F.col("_through")
    return [F.when(ok & (F.col(f"_{k}_time") > 0), F.col(f"_{k}_path") / F.when(F.col(f"_{k}_time") > 0, F.col(f"_{k}_time"))).alias(f"{k}_speed") for k in ("entry", "exit", "average")]


def table(rows: DataFrame, mode: str = "pathlen", regions: tuple[Zone, Zone] | None = None) -> DataFrame:
    """All metrics of each trajectory and junction of a frame in one row (speed_through is that of speed_through(), speed that of totals()), with region times if two regions are given; one aggregation makes them all."""
    g = per_pair(_timed(rows), Decision(), *_transit_facts(), *_time_facts(), *(_region_facts(*regions) if regions else []))
    return g.select(*KEYS, *_timing(mode), *_speed_through(mode, "speed_through"), *_transit(), *_totals(), *(_region_times() if regions else []))


def adaptive(points: DataFrame, at: Sequence[Junction], how: Decision) -> DataFrame:
    """trajectory, junction, seconds, mode_used, speed, speed_mode, entry_speed, exit_speed, average_speed, with distances scaled to how far a trajectory goes.

    pathlen: a twentieth of its length, from 0.1 to 10, and a hundredth (at least 0.01) where that gives no time; radial: a
    ring of a tenth, from 5 to 50, and a twentieth (at least 2); hybrid: as it is. Where a trajectory doesn't enter, the
    values are null and the modes no_entry. One frame and one aggregation give all, the second attempt too.
    """
    total, mode = F.col("total"), how.mode
    clamp = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    first = {"pathlen": {"path_length": clamp(0.05 * total, 0.1, 10.0)}, "radial": {"ring": clamp(0.10 * total, 5.0, 50.0)}, "hybrid": {}}[mode]
    again = {"pathlen": {"again_length": F.greatest(0.01 * total, F.lit(0.01))}, "radial": {"again_ring": F.greatest(0.05 * total, F.lit(2.0))}, "hybrid": {}}[mode]
    rows = _timed(frame(points, at, how, **first, **again))
    retry = [F.max(F.when(F.col("idx") == F.col("again_idx") - (1 if mode == "pathlen" else 0), F.col("t"))).alias("_t_again")] if again else []
    g = per_pair(rows, how, *_transit_facts(), *retry)
    out = g.select(*KEYS, "entered", "t_start", *[F.col(c) for c in ("_t_again",) if again], *_timing(mode), *_speed_through(mode, "speed", "speed_mode"), *_transit())
    if again:
        out = out.withColumn("seconds", F.coalesce("seconds", F.col("_t_again") - F.col("t_start")))
    here = lambda c: F.when(F.col("entered"), F.col(c)).alias(c)
    named = lambda c: F.when(F.col("entered"), F.col(c)).otherwise("no_entry").alias(c)
    return out.select(*KEYS, here("seconds"), named("mode_used"), here("speed"), named("speed_mode"), here("entry_speed"), here("exit_speed"), here("average_speed"))


def junction_means(found: DataFrame) -> DataFrame:
    """junction, time and speed (means over rows with both a time and an average speed), entry_speed and exit_speed (means, where both have any), seconds (mean of all times), of table() or adaptive()."""
    both = F.col("seconds").isNotNull() & F.col("average_speed").isNotNull()
    g = found.groupBy("junction").agg(F.avg(F.when(both, F.col("seconds"))).alias("time"), F.avg(F.when(both, F.col("average_speed"))).alias("speed"), F.avg("entry_speed").alias("_in"), F.avg("exit_speed").alias("_out"), F.avg("seconds").alias("seconds"))
    pair = F.col("_in").isNotNull() & F.col("_out").isNotNull()
    return g.select("junction", "time", "speed", F.when(pair, F.col("_in")).alias("entry_speed"), F.when(pair, F.col("_out")).alias("exit_speed"), "seconds")


#: Relative rank error of the sketches that bracket exact quantiles.
SKETCH = 100_000


def quantiles(values: DataFrame, column: str, ps: Sequence[float], *by: str) -> DataFrame:
    """by and q0, q1, ...: the exact quantiles (linearly interpolated) of a column's values, null without any.

    A sketch brackets each quantile; what lies below a bracket is only counted, and the distinct values inside, a few in a
    hundred thousand of the rows, are ranked. So no task holds or sorts a whole group.
    """
    v = values.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v"))
    cut = lambda sign: F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, p + sign * 2 / SKETCH))) for p in ps]), SKETCH)
    known = v.groupBy(*by).agg(F.count("*").alias("_n"), cut(-1).alias("_low"), cut(1).alias("_high"))
    join = lambda left, right: left.join(right, list(by)) if by else left.crossJoin(F.broadcast(right))
    near = join(v, known)
    low, high = (lambda k: F.col("_low")[k]), (lambda k: F.col("_high")[k])
    outside = near.groupBy(*by, "_n").agg(*[f for k in range(len(ps)) for f in (F.count(F.when(F.col("_v") < low(k), 1)).alias(f"_below{k}"), F.max(F.when(F.col("_v") < low(k), F.col("_v"))).alias(f"_under{k}"), F.min(F.when(F.col("_v") > high(k), F.col("_v"))).alias(f"_over{k}"))])
    inside = F.filter(F.array(*[F.when((F.col("_v") >= low(k)) & (F.col("_v") <= high(k)), F.lit(k)) for k in range(len(ps))]), lambda k: k.isNotNull())
    ranked = near.select(*by, "_v", F.explode(inside).alias("_k")).groupBy(*by, "_k", "_v").agg(F.count("*").alias("_m"))
    ranked = ranked.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*by, "_k").orderBy("_v")))
    spots = F.array(*[F.struct(F.lit(k).alias("_k"), F.lit(p).alias("_p"), *[F.col(f"_{c}{k}").alias(f"_{c}") for c in ("below", "under", "over")]) for k, p in enumerate(ps)])
    at = outside.select(*by, "_n", F.explode(spots).alias("_s")).select(*by, "_s.*", (F.col("_s._p") * (F.col("_n") - 1)).alias("_at"))
    rows = at.join(ranked, [*by, "_k"])
    value = lambda rank: F.min(F.when(F.col("_below") + F.col("_upto") > rank, F.col("_v")))  # noqa: E731  the value at a rank from 0
    floor, ceil = F.floor("_at"), F.ceil("_at")
    g = rows.groupBy(*by, "_k", "_at", "_below", "_under", "_over").agg(value(floor).alias("_lo"), value(ceil).alias("_hi"))
    lo, hi = F.when(floor < F.col("_below"), F.col("_under")).otherwise(F.coalesce("_lo", "_over")), F.when(ceil < F.col("_below"), F.col("_under")).otherwise(F.coalesce("_hi", "_over"))
    exact = g.select(*by, "_k", (lo + (hi - lo) * (F.col("_at") - floor)).alias("_q"))
    return exact.groupBy(*by).agg(*[F.max(F.when(F.col("_k") == k, F.col("_q"))).alias(f"q{k}") for k in range(len(ps))])


def estimate_junction(points: DataFrame, *, approx: bool = False, least: float = 20.0, outer: float = 3.0) -> DataFrame:
    """cx, cz, r, r_outer: a junction at the median of all points, as wide as three quarters of them are near (at least 20). approx takes sketched medians, in fewer passes."""

    def at(values: DataFrame, column: str, p: float, name: str) -> DataFrame:
        if approx:
            return values.agg(F.percentile_approx(column, p, SKETCH).alias(name))
        return quantiles(values, column, [p]).select(F.col("q0").alias(name))

    centre = at(points, "x", 0.5, "cx").crossJoin(at(points, "z", 0.5, "cz"))
    far = points.select("x", "z").crossJoin(F.broadcast(centre))  # one row
    d = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("z") - F.col("cz")) * (F.col("z") - F.col("cz")))
    r = at(far.select(d.alias("d")), "d", 0.75, "d").select(F.greatest("d", F.lit(least)).alias("r"))
    return centre.crossJoin(r).withColumn("r_outer", outer * F.col("r"))


def summaries(values: DataFrame, column: str, *by: str, approx: bool = False) -> DataFrame:
    """Mean, median, extremes, sample deviation and counts of a column, with and without a value, by group."""
    c = F.col(column)
    sketch = [F.percentile_approx(c, 0.5, SKETCH).alias("median")] if approx else []
    g = values.groupBy(*by).agg(F.avg(c).alias("mean"), *sketch, F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_samp(c).alias("std"), F.count(c).alias("valid"), (F.count("*") - F.count(c)).alias("missing"))
    if approx:
        return g
    median = quantiles(values, column, [0.5], *by).withColumnRenamed("q0", "median")
    return g.join(median, list(by), "left") if by else g.join(median, how="left")


def histogram(values: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, left, right, n, density over equal bins from the least to the greatest value (which falls into the last)."""
    v = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("all"))
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(0)
    g = v.crossJoin(F.broadcast(ends)).withColumn("bin", k.cast("int")).groupBy("bin", "lo", "hi", "all").agg(F.count("*").alias("n"))
    return g.select("bin", (F.col("lo") + F.col("bin") * width).alias("left"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right"), "n", F.when(width > 0, F.col("n") / (F.col("all") * F.when(width > 0, width))).alias("density"))


#: Bins of a kernel's bandwidth, moments of a bin, and bandwidths beyond which a kernel is left out.
BINS, MOMENTS, REACH = 8, 8, 9


def density(values: DataFrame, column: str, grid: int = 200) -> DataFrame:
    """at, density: a Gaussian kernel estimate with bandwidth 1.06 * deviation * n^-0.2 at points from the 1st to the 99th percentile.

    A bin an eighth of the bandwidth wide keeps the first eight moments of its values about its middle, from which
    the kernels' sum at a distance x follows by Hermite's polynomials: exp(-(x - d)^2 / 2) is exp(-x^2 / 2) times the sum
    of He_k(x) d^k / k!. With d up to 1/16 what is cut off is under 1.1 / 16^8 / sqrt(8!), 2e-12 of a kernel's peak. Bins
    further than nine bandwidths from every point (3e-18 of a peak) are left out, so there are a bounded number of bins:
    some tens of thousands for 10^12 values.
    """
    v = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    s = v.agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd")).first()
    spark = values.sparkSession
    if not s["n"] or not s["sd"]:
        return spark.createDataFrame([], "at double, density double")
    h = 1.06 * s["sd"] * s["n"] ** -0.2
    p = quantiles(v, "v", [0.01, 0.99]).first()
    width, step = h / BINS, (p["q1"] - p["q0"]) / (grid - 1)
    some = v.where(F.col("v").between(p["q0"] - REACH * h, p["q1"] + REACH * h)).withColumn("bin", F.floor((F.col("v") - p["q0"]) / width))
    middle = F.lit(p["q0"]) + (F.col("bin") + 0.5) * width
    d = (F.col("v") - middle) / h
    power, powers = F.lit(1.0), []
    for k in range(MOMENTS):
        powers.append(F.sum(power).alias(f"m{k}"))
        power = power * d
    binned = some.groupBy("bin").agg(*powers).withColumn("c", middle)
    at = spark.range(grid).select((F.lit(p["q0"]) + F.col("id") * step).alias("at"))
    near = binned.crossJoin(F.broadcast(at)).withColumn("x", (F.col("at") - F.col("c")) / h)  # grid rows
    x = F.col("x")
    lower, he, total = F.lit(0.0), F.lit(1.0), F.lit(0.0)
    for k in range(MOMENTS):
        total = total + he * F.col(f"m{k}") / float(math.factorial(k))
        lower, he = he, x * he - k * lower
    return near.groupBy("at").agg((F.sum(F.exp(-0.5 * x * x) * total) / (s["n"] * h * math.sqrt(2 * math.pi))).alias("density"))


def fit_sums(values: DataFrame, column: str, *by: str) -> DataFrame:
    """The sums that the fits need: n, mean, var (of n), and for the positive values n_pos, mean_log, var_log, mean_pos, var_pos."""
    c, positive = F.col(column), F.when(F.col(column) > 0, F.col(column))
    return values.where(c.isNotNull()).groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var"), F.count(positive).alias("n_pos"), F.avg(F.log(positive)).alias("mean_log"), F.var_pop(F.log(positive)).alias("var_log"), F.avg(positive).alias("mean_pos"), F.var_pop(positive).alias("var_pos"))


def _lgamma(x: Column) -> Column:
    """ln of the gamma function of positive x, by Stirling's series at x + 8."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12.0 * y) - 1 / (360.0 * y * y * y) + 1 / (1260.0 * F.pow(y, F.lit(5.0)))
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return series - F.log(product)


def best_fit(sums: DataFrame) -> DataFrame:
    """The groups of fit_sums() with normal, lognormal and gamma: Akaike's criterion (4 - 2 log-likelihood) of each, null where it can't be fitted, and best, the name of the least."""
    tau, n, m = 2 * math.pi, F.col("n"), F.col("n_pos")
    normal = F.when(F.col("var") > 0, 4 + n * (F.log(tau * F.col("var")) + 1))
    lognormal = F.when(F.col("var_log") > 0, 4 + m * (F.log(tau * F.col("var_log")) + 1) + 2 * m * F.col("mean_log"))
    some = F.col("var_pos") > 0
    shape, scale = F.col("mean_pos") * F.col("mean_pos") / F.when(some, F.col("var_pos")), F.col("var_pos") / F.col("mean_pos")
    gamma = F.when(some, 4 - 2 * m * ((shape - 1) * F.col("mean_log") - F.col("mean_pos") / scale - shape * F.log(scale) - _lgamma(shape)))
    found = sums.withColumns({"normal": normal, "lognormal": lognormal, "gamma": gamma})
    fits = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("aic"), F.lit(c).alias("name"))) for c in ("normal", "lognormal", "gamma")]), lambda f: f.isNotNull())
    return found.withColumn("best", F.array_min(fits)["name"])
