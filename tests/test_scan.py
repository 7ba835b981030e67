"""The pass over sorted points against the frame with a row for each point and junction, and against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.operators import decisions, scan
from strideline.plans import catalog
from strideline.plans.params import Decision, Junction
from strideline.sources.points import FIELDS

AT = [Junction(0, 0, 0, 8, 20), Junction(1, 15, 5, 6, None), Junction(2, -30, 10, 4, 12), Junction(7, 500, 500, 3, 9)]


def points(spark, walks, null_times=False):
    rows = [(str(k), i, float(x), float(z), None if null_times and (k + i) % 7 == 0 else float(i) / 3) for k, w in enumerate(walks) for i, (x, z) in enumerate(w)]
    df = spark.createDataFrame(rows, "trajectory string, idx int, x double, z double, t double")
    return df.withColumns({c: F.lit(None).cast("double") for c in FIELDS if c not in df.columns}).repartition(3)


def walks(n=40, seed=0):
    """Random walks, some of a single point, some that stand still at times, some on a grid where distances tie."""
    rng = np.random.default_rng(seed)
    out = [np.cumsum(rng.normal(0, 3, (rng.integers(1, 90), 2)), axis=0) + rng.normal(0, 15, 2) for _ in range(n)]
    out += [np.cumsum(rng.integers(-1, 2, (60, 2)) * 4.0, axis=0) for _ in range(n // 2)]
    return [*out, np.zeros((1, 2)), np.zeros((5, 2)), np.full((1, 2), 400.0)]


COLUMNS = ["cx", "cz", "r", "ring", "reach", "n", "total", "timed", "median", *scan.INDICES, *scan.VALUES, "entered"]


def facts(df):
    return {(r["trajectory"], r["junction"]): [r[c] for c in COLUMNS] for r in df.collect()}


@pytest.mark.parametrize("batch", [10_000, 11, 1])
@pytest.mark.parametrize("how", [Decision(mode="hybrid", path_length=25.0), Decision(mode="radial", path_length=9.0, window=1, epsilon=2.0), Decision(mode="pathlen", path_length=40.0, window=13, linger_delta=7.0)])
def test_scan_equals_frame(spark, how, batch):
    p = points(spark, walks(), null_times=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = facts(decisions.scan(p, AT, how))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = facts(decisions.per_pair(decisions.frame(p, AT, how), how))
    assert found.keys() == expected.keys() and len(found) == len(walks()) * len(AT)
    for k, values in expected.items():
        for name, a, b in zip(COLUMNS, found[k], values, strict=True):
            assert a == b or (a is not None and b is not None and a == pytest.approx(b, abs=1e-9)), (k, name, a, b)


@pytest.mark.parametrize("gone", ["idx <> 0", "idx <> 3", "not (trajectory = '2' and idx > 4)", "idx < 0"])
def test_indices_have_no_gaps(spark, gone):
    p = points(spark, [w for w in walks(6) if len(w) > 8])
    rows = decisions.scan(p.where(gone), AT)
    if gone == "idx < 0":
        assert rows.count() == 0
    elif gone.startswith("not"):
        assert rows.where("trajectory = '2'").first()["n"] == 5  # a shorter trajectory is one like others
    else:
        with pytest.raises(Exception, match="without gaps"):
            rows.collect()


@pytest.mark.parametrize(("name", "share"), [("path_length", 0.3), ("ring", 0.2)])
def test_lengths_and_rings_of_each_trajectory(spark, name, share):
    scaled = {name: share * F.col("total")}
    p, how = points(spark, walks(20, 3)), Decision(mode="hybrid")
    rows = decisions.frame(p, AT, how, **scaled, **{f"again_{k.removeprefix('path_')}": v for k, v in scaled.items()})
    a, b = decisions.scan(p, AT, how, **scaled), decisions.per_pair(rows, how, F.first("again_idx").alias("again_idx"))
    pick = lambda df: {(r["trajectory"], r["junction"]): (r["radial_idx"], r["pathlen_idx"], r["ring"]) for r in df.collect()}
    assert pick(a) == pick(b)
    again = "pathlen_idx" if "path_length" in scaled else "radial_idx"
    assert b.where(~F.col("again_idx").eqNullSafe(F.col(again))).count() == 0


def test_slabs_of_many_junctions(spark, monkeypatch):
    """Ten thousand junctions and more, taken in turn, against numpy; no plan joins them."""
    rng = np.random.default_rng(8)
    at = [Junction(k, float(x), float(z), 3.0, 9.0) for k, (x, z) in enumerate(rng.uniform(-200, 200, (10_500, 2)))]
    ws = walks(4, 5)
    found = decisions.scan(points(spark, ws), at, Decision(mode="radial"))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.select("trajectory", "junction", "start", "entered", "nearest").toPandas().sort_values(["trajectory", "junction"])
    cx, cz = (np.array([getattr(j, c) for j in at]) for c in ("cx", "cz"))
    for k, w in enumerate(ws):
        mine = got[got.trajectory == str(k)]
        dist = np.sqrt((w[:, :1] - cx) ** 2 + (w[:, 1:] - cz) ** 2)
        inside = dist <= 3.0
        assert mine.entered.tolist() == inside.any(axis=0).tolist()
        assert mine.nearest.tolist() == dist.argmin(axis=0).tolist()
        assert mine.start.tolist() == np.where(inside.any(axis=0), inside.argmax(axis=0), dist.argmin(axis=0)).tolist()


@pytest.mark.parametrize("name", ["decision_points", "assign_fixed_centers", "head_yaw", "metrics_table", "adaptive_radial", "adaptive_pathlen", "gaze_headlines", "timing_modes"])
def test_one_shuffle_of_the_points(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(trajectory") == 1 and plan.count("FileScan") == 1
    assert "CartesianProduct" not in plan
