"""The registry of trajectory queries over the events adapter, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.functions.geometry import circular_mean, direction, in_disc, in_rectangle, in_tilted
from strideline.operators import branches, clustering, decisions, enhanced, flows, gaze, intent, metrics, trees
from strideline.plans.params import Decision, Junction, Zone
from strideline.plans.sql import QUERIES
from strideline.sources import points as source
from strideline.sources.scratch import settled

JUNCTIONS = [Junction(0, 0, 0, 60, 120), Junction(1, 100, 0, 60, 100), Junction(2, 0, 150, 60, 100), Junction(3, -150, -50, 60, 120)]
#: Steps are multiples of 0.01, so this length is never met exactly.
HOW = Decision(mode="hybrid", path_length=100.005)
ALONG = Decision(mode="pathlen", path_length=HOW.path_length)

HOME, EAST = Zone("A", circle=(0.0, 0.0, 60.0)), Zone("B", rectangle=(80.0, 300.0, -200.0, 200.0))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.events_as_points(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points some of whose trajectories lack some signals."""
    lacking = {"head_forward_z": (3, 0), "gaze_y": (4, 1), "pupil_l": (5, 2), "pupil_r": (7, 3), "heart_rate": (11, 4)}
    return _points(spark, sf_dir).withColumns({c: F.when(F.col("trajectory").cast("long") % m != r, F.col(c)) for c, (m, r) in lacking.items()})


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.frame(_points(spark, sf_dir), JUNCTIONS, HOW)


def _pairs(spark: SparkSession, sf_dir: str, how: Decision = HOW) -> DataFrame:
    return decisions.scan(_points(spark, sf_dir), JUNCTIONS, how)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.directions(_pairs(spark, sf_dir), HOW)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branches.assign(_vectors(spark, sf_dir), _centers(spark), angle_eps=40.0)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("trajectory", "junction", "branch")


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.visits(_points(spark, sf_dir), JUNCTIONS)


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.counts(flows.transitions(_visits(spark, sf_dir)))


def _indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decision_indices(_pairs(spark, sf_dir), "hybrid")


def _points_of_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decision_points(_pairs(spark, sf_dir), HOW)


def _centers(spark: SparkSession) -> DataFrame:
    return branches.centers_table(spark, {j.junction: [(1, 0), (0, 1), (-1, 0), (0, -1)] for j in JUNCTIONS})


def _rounded(df: DataFrame, places: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, as sums in another order differ in their last bits; no negative zeros."""
    return df.withColumns({c: F.round(F.col(c), other.get(c, places)) + 0.0 for c, t in df.dtypes if t == "double"})


def _query(made: Callable[[SparkSession, str], DataFrame], places: int = 6, **other: int):
    return lambda spark, sf_dir: _rounded(made(spark, sf_dir), places, **other)


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, z = F.col("x"), F.col("z")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return _points(spark, sf_dir).agg(n(in_disc(x, z, 0.0, 0.0, 60.0), "in_circle"), n(in_rectangle(x, z, -50.0, 80.0, 0.0, 120.0), "in_rectangle"))


def _tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = in_tilted(F.col("x"), F.col("z"), -40.0, 80.0, 10.0, 70.0, tilt=30.0, tolerance=0.001)
    return _points(spark, sf_dir).where(inside).agg(F.count("*").alias("n"))


def _silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.silhouette(_labels(spark, sf_dir).join(_vectors(spark, sf_dir), ["trajectory", "junction"]))


def _heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaze.pupil_heatmap(_points(spark, sf_dir))


def _found(part: int, method: str):
    return lambda spark, sf_dir: branches.discover(_points(spark, sf_dir), JUNCTIONS, HOW, method=method)[part]


def _known(spark: SparkSession) -> gaze.Known:
    return gaze.Known(_centers(spark), HOW, 40.0)


def _yaws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaze.head_yaw(_frame(spark, sf_dir), "hybrid", _known(spark))


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(intent.labelled(intent.features(_frame(spark, sf_dir), 50.0), _labels(spark, sf_dir)), "features")
    return intent.predict(intent.train(rows), rows)


def _boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(intent.labelled(intent.features(_frame(spark, sf_dir), 50.0), _labels(spark, sf_dir)), "features")
    return intent.predict(intent.train(rows, trees.Boosted(trees=20, depth=3, rate=0.3)), rows).drop("probabilities")


def _accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intent.analyze(_frame(spark, sf_dir), _labels(spark, sf_dir), distances=(50.0,), folds_of=3)
    return intent.junction_summary(found)


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.table(_frame(spark, sf_dir), "hybrid", (HOME, EAST))


def _adaptive(mode: str):
    return lambda spark, sf_dir: metrics.adaptive(_points(spark, sf_dir), JUNCTIONS, Decision(mode=mode))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branches.chain(_labels(spark, sf_dir), [j.junction for j in JUNCTIONS])


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _labels(spark, sf_dir)
    return branches.inconsistencies(found.unionByName(found.where("junction = 1")))


def _at(spark: SparkSession) -> DataFrame:
    return decisions.junction_table(spark, JUNCTIONS)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.with_steps(_points(spark, sf_dir))


def queries() -> dict:
    labels = _labels
    return {
        "flow_conditional": _query(lambda s, d: flows.conditional(_flow(s, d))),
        "scan_filter_scale": lambda s, d: _points(s, d).where("x is not null and z is not null").select("trajectory", "idx", *[(F.col(c) * 0.5).alias(c) for c in ("x", "z")]),
        "trim_static_prefix": _query(lambda s, d: source.trim_static(_points(s, d), 20.0).select("trajectory", "idx", "x", "z", "t"), 9),
        "capabilities": lambda s, d: source.capabilities(_sparse(s, d)),
        "overview": lambda s, d: source.overview(_points(s, d)),
        "step_and_path_length": _query(lambda s, d: metrics.totals(_points(s, d))),
        "junction_entry": lambda s, d: decisions.entries(_pairs(s, d)),
        "circle_rect_membership": _membership,
        "zone_membership_tilted": _tilted,
        "radial_decision_index": lambda s, d: decisions.decision_indices(_pairs(s, d), "radial").select("trajectory", "junction", "decision_idx"),
        "pathlen_decision_index": lambda s, d: decisions.decision_indices(_pairs(s, d), "pathlen").select("trajectory", "junction", "decision_idx"),
        "hybrid_decision": _indices,
        "direction_vectors": _query(_vectors),
        "decision_points": _points_of_decision,
        "first_within_ring": lambda s, d: decisions.first_within(_pairs(s, d)),
        "near_ring_intercepts": lambda s, d: decisions.near_ring(_frame(s, d), 110.0),
        "clip_to_area": lambda s, d: decisions.clip_to_area(_frame(s, d)).groupBy("trajectory", "junction").agg(F.count("*").alias("n")),
        "clip_to_ring": lambda s, d: decisions.clip_to_ring(_frame(s, d)).groupBy("trajectory", "junction").agg(F.count("*").alias("n")),
        "assign_fixed_centers": _query(_assigned),
        "branch_summary": _query(lambda s, d: branches.summary(labels(s, d))),
        "branch_entropy": _query(lambda s, d: branches.entropy(branches.summary(labels(s, d)))),
        "split_small_branches": lambda s, d: branches.split_small(labels(s, d), 0.2),
        "status_counts": lambda s, d: branches.status_counts(labels(s, d), _points(s, d)),
        "chain_wide": lambda s, d: branches.chain(labels(s, d), [j.junction for j in JUNCTIONS]),
        "branch_silhouette": _query(_silhouette),
        "dbscan_branches": _found(0, "dbscan"),
        "dbscan_centers": _query(_found(1, "dbscan")),
        "discovered_chain": lambda s, d: branches.discover_chain(_points(s, d), JUNCTIONS, HOW)[0],
        "kmeans_branches": _found(0, "auto"),
        "timing_modes": _query(lambda s, d: metrics.timing(_pairs(s, d), "hybrid")),
        "regions_dt": _query(lambda s, d: metrics.between_regions(_points(s, d), HOME, EAST)),
        "speed_through_junction": _query(lambda s, d: metrics.speed_through(_pairs(s, d), "hybrid")),
        "transit_speed": _query(lambda s, d: metrics.transit(_frame(s, d))),
        "junction_estimate": _query(lambda s, d: metrics.estimate_junction(_points(s, d))),
        "metric_summaries": _query(lambda s, d: metrics.summaries(metrics.timing(_pairs(s, d), "hybrid"), "seconds", "junction")),
        "step_histogram": lambda s, d: metrics.histogram(decisions.with_steps(_points(s, d)), "seg").select("bin", "n"),
        "step_density": _query(lambda s, d: metrics.density(_steps(s, d), "seg"), 6, density=9),
        "fit_sums": _query(lambda s, d: metrics.fit_sums(decisions.with_steps(_points(s, d)).where("seg > 0"), "seg").select("n", "mean", "var", "n_pos", "mean_log", "var_log"), var=4),
        "visit_sequence": lambda s, d: _visits(s, d).select("trajectory", "visit", "junction"),
        "transition_counts": _flow,
        "flow_overall": _query(lambda s, d: flows.overall(_flow(s, d), _points(s, d)), 9),
        "flow_fan_out": lambda s, d: flows.fan_out(_flow(s, d)),
        "flow_strength": _query(lambda s, d: flows.strength(flows.conditional(_flow(s, d)))),
        "flow_predictions": _query(lambda s, d: flows.predictions(flows.conditional(_flow(s, d))), 9),
        "flow_threshold": _query(lambda s, d: flows.strong(flows.overall(_flow(s, d), _points(s, d)), 0.1), 9),
        "direct_flows": _query(lambda s, d: flows.direct(_points(s, d), JUNCTIONS, labels(s, d)), 9),
        "second_order_after": _query(lambda s, d: flows.after(_visits(s, d))),
        "second_order_before": _query(lambda s, d: flows.before(_visits(s, d))),
        "route_patterns": _query(lambda s, d: flows.routes(branches.chain(labels(s, d).where("branch >= 0"), [j.junction for j in JUNCTIONS])), 9),
        "zone_flows": _query(lambda s, d: flows.zone_flows(flows.visits_with_zones(_points(s, d), JUNCTIONS, [HOME], [EAST])), 9),
        "head_yaw": _query(_yaws),
        "yaw_consistency": _query(lambda s, d: gaze.consistency(_yaws(s, d), "junction")),
        "physiology_windows": _query(lambda s, d: gaze.physiology(_frame(s, d), "hybrid")),
        "pupil_windows": _query(lambda s, d: gaze.pupil_windows(_frame(s, d), "hybrid")),
        "pupil_heatmap": _query(_heat),
        "pupil_heatmap_max": _query(lambda s, d: gaze.pupil_heatmap(_points(s, d), how="zscore", combine="max")),
        "mean_headings": _query(lambda s, d: _steps(s, d).where("seg > 0").groupBy("trajectory").agg(circular_mean(direction(F.col("dx"), F.col("dz"))).alias("heading"))),
        "sharpest_turns": _query(lambda s, d: metrics.turns(_steps(s, d))),
        "split_outliers": lambda s, d: branches.split_small(labels(s, d), 0.2, outlier_min=200).where("branch >= 0").groupBy("junction", "branch").agg(F.max("is_small").alias("is_small"), F.max("main_branch").alias("main_branch")),
        "junction_heatmaps": _query(lambda s, d: gaze.junction_heatmaps(_frame(s, d), combine="max")),
        "heatmap_scale": lambda s, d: gaze.common_scale(_heat(s, d)),
        "movement_patterns": _query(lambda s, d: gaze.movement(_frame(s, d), decisions.first_within(_pairs(s, d)))),
        "bottlenecks": _query(lambda s, d: enhanced.bottlenecks(labels(s, d), narrow=0.2, severe=0.3), 9),
        "balanced_routes": _query(lambda s, d: enhanced.balanced(labels(s, d)), 9),
        "flow_analysis": _query(lambda s, d: enhanced.flow_analysis(labels(s, d)).select("junction", "total", "entropy", F.to_json("flow").alias("flow")), 9),
        "risk": _query(lambda s, d: enhanced.risk(labels(s, d)), 9),
        "overall_risk": _query(lambda s, d: enhanced.overall_risk(labels(s, d)), 9),
        "efficiency": _query(lambda s, d: enhanced.efficiency(labels(s, d)), 9),
        "overall_efficiency": _query(lambda s, d: enhanced.overall_efficiency(labels(s, d)), 9),
        "recommendations": lambda s, d: enhanced.recommendations(labels(s, d), narrow=0.2, severe=0.3),
        "enhanced_overview": _query(lambda s, d: enhanced.overview(labels(s, d)).drop("analysed_at"), 9),
        "directions_radial": _query(lambda s, d: decisions.directions(_pairs(s, d, Decision(mode="radial")), Decision(mode="radial"))),
        "directions_pathlen": _query(lambda s, d: decisions.directions(_pairs(s, d, ALONG), ALONG)),
        "diagnostics": lambda s, d: decisions.diagnostics(_points_of_decision(s, d)),
        "first_decisions": lambda s, d: decisions.first_decisions(_frame(s, d), Decision(mode="pathlen")),
        "first_decisions_hybrid": lambda s, d: decisions.first_decisions(_frame(s, d), HOW, wide=110.0),
        "searched_decisions": lambda s, d: decisions.searched(_frame(s, d), HOW, F.col("r")),
        "nearest_points": lambda s, d: decisions.nearest_points(_pairs(s, d)),
        "clip_to_window": lambda s, d: decisions.clip_to_window(_frame(s, d), 70.0).groupBy("trajectory", "junction").agg(F.count("*").alias("n")),
        "thinned": lambda s, d: source.thinned(_points(s, d), 20).select("trajectory", "idx", "x", "z"),
        "with_signals": lambda s, d: source.with_signals(_sparse(s, d)).groupBy("trajectory").agg(F.count("*").alias("n")),
        "timing_pathlen": _query(lambda s, d: metrics.timing(_pairs(s, d), "pathlen")),
        "timing_radial": _query(lambda s, d: metrics.timing(_pairs(s, d), "radial")),
        "metrics_table": _query(_table),
        "adaptive_pathlen": _query(_adaptive("pathlen")),
        "adaptive_radial": _query(_adaptive("radial")),
        "junction_means": _query(lambda s, d: metrics.junction_means(_adaptive("radial")(s, d)), 4),
        "best_fit": _query(lambda s, d: metrics.best_fit(metrics.fit_sums(_steps(s, d).where("seg > 0"), "seg")).select("n", "normal", "lognormal", "gamma", "best"), 1),
        "head_yaw_histogram": lambda s, d: metrics.histogram(_yaws(s, d), "head_yaw", 20).select("bin", "n"),
        "label_summary": _query(lambda s, d: branches.summary(labels(s, d), every=True)),
        "summary_with_entropy": _query(lambda s, d: branches.summary_with_entropy(branches.summary(labels(s, d)))),
        "normalized_assignments": lambda s, d: branches.normalized(_chains(s, d), _points_of_decision(s, d), 1)[0].select("trajectory", "branch_j1", "decision_idx", "intercept_x", "intercept_z"),
        "assignment_coverage": lambda s, d: branches.normalized(_chains(s, d), known=_points(s, d).where("cast(trajectory as int) % 2 = 0"))[1],
        "numbered_trajectories": lambda s, d: branches.numbered(labels(s, d)),
        "repeated_assignments": _twice,
        "branch_directions": _query(lambda s, d: branches.branch_directions(labels(s, d), _points_of_decision(s, d), _at(s))),
        "center_mismatches": _query(lambda s, d: gaze.mismatches(_points_of_decision(s, d), labels(s, d), _centers(s), _at(s))),
        "heart_rate_quartiles": _query(lambda s, d: gaze.quartiles(_yaws(s, d), "heart_rate", "junction", "branch")),
        "sample_timing": lambda s, d: gaze.sample_timing(_frame(s, d), "hybrid"),
        "values_at_decisions": lambda s, d: gaze.values_at(_frame(s, d), "hybrid", "gaze_x", "gaze_y", "heart_rate"),
        "visit_movement": _query(lambda s, d: gaze.movement_of_visits(_frame(s, d), _visits(s, d))),
        "gaze_headlines": _query(lambda s, d: gaze.headlines(gaze.at_decisions(_frame(s, d), "hybrid", _known(s)))),
        "heatmap_statistics": _query(lambda s, d: gaze.heatmap_statistics(_heat(s, d))),
        "zone_points": lambda s, d: flows.zone_points(_points(s, d), [HOME], [EAST]),
        "flow_results": lambda s, d: flows.results(_flow(s, d), _visits(s, d)),
        "route_statistics": _query(lambda s, d: flows.route_statistics(branches.chain(labels(s, d).where("branch >= 0"), [j.junction for j in JUNCTIONS])), 9),
        "intent_accuracy": _accuracies,
        "intent_features": _query(lambda s, d: intent.features(_frame(s, d), 50.0), 5),
        "intent_random_forest": _forest,
        "intent_boosted": _query(_boosted),
    }


def oracle_sql() -> dict:
    return dict(QUERIES)
