"""Head, gaze and physiology at decisions, and pupil heat maps."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.geometry import length, wrapped, yaw
from strideline.operators.branches import with_branch
from strideline.operators.decisions import KEYS, decision_index, per_pair, with_directions
from strideline.operators.metrics import quantiles
from strideline.plans.params import Decision


def _mean_pupil() -> Column:
    """Mean of the eyes that have a value."""
    n = F.when(F.col("pupil_l").isNotNull(), 1).otherwise(0) + F.when(F.col("pupil_r").isNotNull(), 1).otherwise(0)
    return F.when(n > 0, (F.coalesce("pupil_l", F.lit(0.0)) + F.coalesce("pupil_r", F.lit(0.0))) / F.when(n > 0, n))


def _decided(rows: DataFrame, decisions: DataFrame | str) -> DataFrame:
    """rows with decision_idx: of a table of them, or a mode's own from the frame, which needs no join. Without one, rows drop out."""
    if isinstance(decisions, str):
        return rows.drop("branch").withColumn("decision_idx", decision_index(decisions)).where("decision_idx is not null")
    return rows.drop("branch", "decision_idx").join(decisions.where("decision_idx is not null").select(*KEYS, "decision_idx"), list(KEYS))


class Known(NamedTuple):
    """Branches by known centres, which are assigned in the same aggregation as what is asked about them."""

    centers: DataFrame
    how: Decision
    angle_eps: float = 15.0


def at_decisions(rows: DataFrame, decisions: DataFrame | str, known: Known | None = None, *, within: int = 200, near: float = 2.0, far: float = 5.0, window: float = 3.0, last: int = 10) -> DataFrame:
    """What head_yaw(), physiology() and pupil_windows() say about each trajectory and junction with a decision, from one aggregation of a frame; what is not selected of it is not computed. With known, branch too."""
    w, whole = Window.partitionBy(*KEYS).orderBy("idx"), Window.partitionBy(*KEYS)
    move = {"mx": F.lead("x").over(w) - F.lag("x").over(w), "mz": F.lead("z").over(w) - F.lag("z").over(w)}
    both = _decided(rows.withColumns(move), decisions)
    at = lambda i: F.max(F.when(F.col("idx") == i, F.col("t"))).over(whole)
    both = both.withColumns({"t_in": at(F.col("start")), "t_dec": at(F.col("decision_idx")), "pupil": _mean_pupil()})
    both = both.withColumn("_early", F.col("pupil").isNotNull() & (F.col("t") < F.col("t_dec") - window))
    both = both.withColumn("_rank", F.row_number().over(Window.partitionBy(*KEYS, "_early").orderBy(F.desc("idx"))))
    off = F.abs(F.col("idx") - F.col("decision_idx"))
    valid = F.col("head_forward_x").isNotNull() & F.col("head_forward_z").isNotNull() & (off <= within)
    sample = F.struct(off.alias("off"), "idx", "head_forward_x", "head_forward_z", "heart_rate", "pupil")
    here = F.when((off == 0) & (length(F.col("mx"), F.col("mz")) > 1e-6), F.struct("mx", "mz"))
    t = F.col("t")
    base, choice = t.between(F.col("t_in") - far, F.col("t_in") - near), t.between(F.col("t_in"), F.col("t_dec"))
    close = t.between(F.col("t_dec") - window, F.col("t_dec") + window)
    facts = [
        F.min(F.when(valid, sample)).alias("_sample"), F.max(here).alias("_move"), F.first("decision_idx").alias("decision_idx"),
        *[F.avg(F.when(when, F.col(c))).alias(f"_{c}_{n}") for c in ("heart_rate", "pupil") for n, when in (("baseline", base), ("decision", choice))],
        F.avg(F.when(F.col("_early") & (F.col("_rank") <= last), F.col("pupil"))).alias("_late_pupil"), F.avg(F.when(close, F.col("pupil"))).alias("_near_pupil"),
    ]
    if known is None:
        return both.groupBy(*KEYS).agg(*facts)
    return with_branch(with_directions(per_pair(both, known.how, *facts), known.how), known.centers, known.angle_eps)


def _yaw_columns() -> list[Column]:
    head, movement = yaw(F.col("_sample.head_forward_x"), F.col("_sample.head_forward_z")), yaw(F.col("_move.mx"), F.col("_move.mz"))
    return [F.col("_sample.idx").alias("valid_idx"), head.alias("head_yaw"), movement.alias("movement_yaw"), wrapped(head - movement).alias("yaw_difference"), F.col("_sample.heart_rate").alias("heart_rate"), F.col("_sample.pupil").alias("pupil")]


def _physiology_columns() -> list[Column]:
    own = lambda c, n: F.col(f"_{c}_{n}")
    return [*[own(c, n).alias(f"{c}_{n}") for c in ("heart_rate", "pupil") for n in ("baseline", "decision")], *[(own(c, "decision") - own(c, "baseline")).alias(f"{c}_change") for c in ("heart_rate", "pupil")]]


def _pupil_columns() -> list[Column]:
    return [F.col("_late_pupil").alias("pupil_baseline"), F.col("_near_pupil").alias("pupil_decision"), (F.col("_near_pupil") - F.col("_late_pupil")).alias("pupil_change")]


def head_yaw(rows: DataFrame, decisions: DataFrame | str, assignments: DataFrame | Known, *, within: int = 200) -> DataFrame:
    """trajectory, junction, branch, decision_idx, valid_idx, head_yaw, movement_yaw, yaw_difference, heart_rate, pupil at the decisions of assigned trajectories.

    The head's sample is the nearest one with a forward vector, at most `within` rows away, the earlier of two; the
    movement is the central difference about the decision. A table of assignments is joined; Known ones need no join.
    """
    if isinstance(assignments, Known):
        g = at_decisions(rows, decisions, assignments, within=within).where("branch >= 0")
    else:
        g = at_decisions(rows, decisions, within=within).join(assignments.where("branch >= 0").select(*KEYS, "branch"), list(KEYS))
    return g.select(*KEYS, "branch", "decision_idx", *_yaw_columns())


def physiology(rows: DataFrame, decisions: DataFrame | str, *, near: float = 2.0, far: float = 5.0) -> DataFrame:
    """trajectory, junction and baseline, decision and change of heart rate and pupil: means over [entry - far, entry - near] and over entry to decision."""
    return at_decisions(rows, decisions, near=near, far=far).select(*KEYS, *_physiology_columns())


def pupil_windows(rows: DataFrame, decisions: DataFrame | str, *, window: float = 3.0, last: int = 10) -> DataFrame:
    """trajectory, junction, pupil_baseline, pupil_decision, pupil_change: means over the decision's time plus and minus window, and over the last ten valid samples before that."""
    return at_decisions(rows, decisions, window=window, last=last).select(*KEYS, *_pupil_columns())


def consistency(yaws: DataFrame, *by: str, limit: float = 30.0) -> DataFrame:
    """n, mean_abs_difference and percent_aligned (under limit degrees) of yaw differences, over all or by columns."""
    d = F.abs("yaw_difference")
    return yaws.where("yaw_difference is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_abs_difference"), (100.0 * F.avg((d < limit).cast("double"))).alias("percent_aligned"))


def mismatches(points: DataFrame, assignments: DataFrame, centers: DataFrame, at: DataFrame) -> DataFrame:
    """junction, n, mismatch_rate: how often the centre nearest to a decision point's direction is not the assigned branch."""
    both = points.where("intercept_x is not null").join(assignments.where("branch >= 0"), list(KEYS)).join(at.select("junction", "cx", "cz"), "junction")
    near = both.join(centers.select("junction", F.col("branch").alias("center"), "ux", "uz"), "junction").withColumn("dot", (F.col("intercept_x") - F.col("cx")) * F.col("ux") + (F.col("intercept_z") - F.col("cz")) * F.col("uz"))
    best = near.groupBy(*KEYS, "branch").agg((-F.max(F.struct("dot", (-F.col("center")).alias("turn")))["turn"]).alias("center"))
    return best.groupBy("junction").agg(F.count("*").alias("n"), F.avg((F.col("center") != F.col("branch")).cast("double")).alias("mismatch_rate"))


def quartiles(values: DataFrame, column: str, *by: str) -> DataFrame:
    """q1, median, q3 of a column by group."""
    q = quantiles(values, column, [0.25, 0.5, 0.75], *by)
    return q.select(*by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))


def _marked(rows: DataFrame) -> DataFrame:
    """rows with movement_yaw, approach_yaw and exit_yaw; steps of 1e-3 or less have no heading."""
    w = Window.partitionBy(*KEYS).orderBy("idx")
    step = lambda a, b: F.when(length(a[0] - b[0], a[1] - b[1]) > 1e-3, yaw(a[0] - b[0], a[1] - b[1]))
    here, prev, following = [(F.col("x"), F.col("z"))] + [(f("x").over(w), f("z").over(w)) for f in (F.lag, F.lead)]
    return rows.withColumns({"movement_yaw": step(following, prev), "approach_yaw": step(here, prev), "exit_yaw": step(following, here)})


def movement(rows: DataFrame, indices: DataFrame | str) -> DataFrame:
    """trajectory, junction, decision_idx, movement_yaw, approach_yaw, exit_yaw, distance, progress, t at given indices."""
    both = _decided(_marked(rows), indices).where("idx = decision_idx")
    return both.select(*KEYS, "decision_idx", "movement_yaw", "approach_yaw", "exit_yaw", F.col("dist").alias("distance"), (F.col("idx") / F.col("n")).alias("progress"), "t")


def movement_of_visits(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """movement() and visit, x, z for every visit of flows.visits(): each visit to a junction is described at the trajectory's first point within reach there."""
    at = F.min(F.when(F.col("dist") <= F.col("reach"), F.col("idx"))).over(Window.partitionBy(*KEYS))
    first = _marked(rows).withColumn("decision_idx", at).where("idx = decision_idx")
    both = seen.select(*KEYS, "visit").join(first, list(KEYS))
    return both.select(*KEYS, "visit", "decision_idx", "n", (F.col("idx") / F.col("n")).alias("progress"), "movement_yaw", "approach_yaw", "exit_yaw", F.col("dist").alias("distance"), "x", "z", "t")


def headlines(found: DataFrame) -> DataFrame:
    """Plain means over all rows with a value, also of angles, of at_decisions() with Known branches: heart_rate_change, pupil_change, pupil_baseline, pupil_decision; of those with a branch head_yaw and yaw_difference; and measurements, the rows."""
    assigned = lambda c: F.when(F.col("branch") >= 0, c)
    named = dict(zip(("valid_idx", "head_yaw", "movement_yaw", "yaw_difference"), _yaw_columns()))
    change = _physiology_columns()[4]
    return found.agg(F.avg(change).alias("heart_rate_change"), F.count("*").alias("measurements"), *[F.avg(c).alias(n) for n, c in zip(("pupil_baseline", "pupil_decision", "pupil_change"), _pupil_columns())], *[F.avg(assigned(named[n])).alias(n) for n in ("head_yaw", "yaw_difference")])


def sample_timing(rows: DataFrame, decisions: DataFrame | str, window: float = 3.0) -> DataFrame:
    """trajectory, junction, before, after, difference: samples in the window of time before and after the decision."""
    both = _decided(rows, decisions).withColumn("t_dec", F.max(F.when(F.col("idx") == F.col("decision_idx"), F.col("t"))).over(Window.partitionBy(*KEYS)))
    t = F.col("t") - F.col("t_dec")
    g = both.groupBy(*KEYS).agg(F.count(F.when((t >= -window) & (t < 0), 1)).alias("before"), F.count(F.when((t > 0) & (t <= window), 1)).alias("after"))
    return g.withColumn("difference", F.col("after") - F.col("before"))


def values_at(rows: DataFrame, decisions: DataFrame | str, *columns: str) -> DataFrame:
    """trajectory, junction, decision_idx and columns' values there."""
    return _decided(rows, decisions).where("idx = decision_idx").select(*KEYS, "decision_idx", *columns)


def normalized_pupil(points: DataFrame, how: str = "relative", *by: str) -> DataFrame:
    """points with value, the mean pupil against its trajectory's own: percent of the mean ('relative') or population deviations ('zscore'); trajectories with fewer than two samples, or nothing to divide by, drop out."""
    if how not in ("relative", "zscore"):
        raise ValueError("how must be relative or zscore")
    w = Window.partitionBy("trajectory", *by)
    p = points.withColumn("pupil", _mean_pupil()).where("pupil is not null")
    p = p.withColumns({"_n": F.count("pupil").over(w), "_mean": F.avg("pupil").over(w), "_sd": F.stddev_pop("pupil").over(w)})
    base = F.col("_mean") if how == "relative" else F.col("_sd")
    p = p.where((F.col("_n") >= 2) & (base != 0))
    value = (F.col("pupil") - F.col("_mean")) / F.when(base != 0, base) * (100.0 if how == "relative" else 1.0)
    return p.withColumn("value", value).drop("_n", "_mean", "_sd")


def pupil_heatmap(points: DataFrame, *, how: str = "relative", combine: str = "mean", cells: int = 10, cell_size: float | None = None, by: tuple[str, ...] = (), box: tuple[Column, Column, Column, Column] | None = None) -> DataFrame:
    """ix, iz, value, n (and by) of a sparse grid over the points, or over a box (x0, x1, z0, z1).

    Without a box the extent is widened by 5 percent on each side. cell_size gives max(5, extent // size) cells a side.
    'mean' averages a cell, its last edge included; 'max' takes the value of the greatest magnitude (a positive one of
    two), the last edge left out.
    """
    v = normalized_pupil(points, how, *by)
    if box is None:
        e = v.agg(*[f(c).alias(f"{c}{k}") for c in ("x", "z") for k, f in ((0, F.min), (1, F.max))])
        v = v.crossJoin(F.broadcast(e))  # one row
        pad = lambda c: 0.05 * (F.col(f"{c}1") - F.col(f"{c}0"))
        box = F.col("x0") - pad("x"), F.col("x1") + pad("x"), F.col("z0") - pad("z"), F.col("z1") + pad("z")
    x0, x1, z0, z1 = box
    side = F.lit(cells) if cell_size is None else F.greatest(F.lit(5), F.floor(F.greatest(x1 - x0, z1 - z0) / cell_size))
    scaled = lambda c, lo, hi: (F.col(c) - lo) / F.when(hi > lo, hi - lo) * side
    u, w = scaled("x", x0, x1), scaled("z", z0, z1)
    v = v.withColumns({"_u": u, "_w": w, "_side": side})
    last = F.col("_side") if combine == "mean" else F.lit(-1)
    cell = lambda c: F.when(F.col(c) == last, F.col("_side") - 1).otherwise(F.floor(c)).cast("int")
    inside = (F.col("_u") >= 0) & (F.col("_w") >= 0) & ((F.col("_u") < F.col("_side")) | (F.col("_u") == last)) & ((F.col("_w") < F.col("_side")) | (F.col("_w") == last))
    value = F.avg("value") if combine == "mean" else F.max(F.struct(F.abs("value").alias("size"), "value"))["value"]
    return v.where(inside).groupBy(*by, cell("_u").alias("ix"), cell("_w").alias("iz")).agg(value.alias("value"), F.count("*").alias("n"))


def junction_heatmaps(rows: DataFrame, *, how: str = "relative", combine: str = "mean", cells: int = 10, factor: float = 1.2) -> DataFrame:
    """junction, ix, iz, value, n over the points within each ring, in a square of factor rings about the centre."""
    c = lambda name, s: F.col(name) + s * factor * F.col("ring")
    return pupil_heatmap(rows.where("dist <= ring"), how=how, combine=combine, cells=cells, by=("junction",), box=(c("cx", -1), c("cx", 1), c("cz", -1), c("cz", 1)))


def heatmap_statistics(heat: DataFrame) -> DataFrame:
    return heat.agg(F.avg("value").alias("mean"), F.max(F.abs("value")).alias("max_abs"), F.max("value").alias("max"), F.min("value").alias("min"), F.count("*").alias("cells"))


def common_scale(heat: DataFrame, how: str = "relative") -> DataFrame:
    """low, high of a colour scale that several maps share: the first tier that holds all values, or mean plus and minus three deviations; 10 without values."""
    g = heat.agg(F.max(F.abs("value")).alias("top"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    top = F.col("top")
    tier = F.when(top <= 5, 5.0).when(top <= 10, 10.0).when(top <= 25, 25.0).when(top <= 50, 50.0).otherwise(60.0)
    if how == "zscore":
        low, high = F.col("mean") - 3 * F.col("sd"), F.col("mean") + 3 * F.col("sd")
    else:
        low, high = -tier, tier
    return g.select(F.when(top.isNull(), -10.0).otherwise(low).alias("low"), F.when(top.isNull(), 10.0).otherwise(high).alias("high"))
