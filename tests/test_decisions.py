"""Index-exact comparison with plain numpy restatements on random walks, and hand fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.operators import branches, clustering, decisions, metrics
from strideline.plans.params import Decision, Junction
from strideline.sources.points import FIELDS

AT = [Junction(0, 0, 0, 8, 20), Junction(1, 15, 5, 6, None)]


def points(spark, walks):
    rows = [(str(k), i, float(x), float(z), float(i)) for k, w in enumerate(walks) for i, (x, z) in enumerate(w)]
    df = spark.createDataFrame(rows, "trajectory string, idx int, x double, z double, t double")
    return df.withColumns({c: F.lit(None).cast("double") for c in FIELDS if c not in df.columns})


def walks(n=60, seed=0):
    rng = np.random.default_rng(seed)
    return [np.cumsum(rng.normal(0, 3, (rng.integers(1, 60), 2)), axis=0) + rng.normal(0, 15, 2) for _ in range(n)]


def expected(w, j, length, window=5):
    r = np.hypot(w[:, 0] - j.cx, w[:, 1] - j.cz)
    inside = np.flatnonzero(r <= j.r)
    start = int(inside[0]) if len(inside) else int(r.argmin())
    radial = None
    for i in range(start + 1, len(r)):
        part = r[max(start + 1, i - window) : i + 1]
        if r[i] >= j.ring and (len(part) < 2 or np.diff(part).mean() >= 0):
            radial = i
            break
    far = np.flatnonzero(np.cumsum(np.hypot(*np.diff(w[start:], axis=0).T)) >= length)
    return bool(len(inside)), start, radial, start + int(far[0]) + 1 if len(far) else None


def test_indices_equal_numpy(spark):
    ws = walks()
    how = Decision(mode="hybrid", path_length=25.0)
    rows = decisions.frame(points(spark, ws), AT, how)
    entry = {(r["trajectory"], r["junction"]): (r["entered"], r["start_idx"]) for r in decisions.entries(rows).collect()}
    found = {(r["trajectory"], r["junction"]): (r["radial_idx"], r["pathlen_idx"], r["decision_idx"]) for r in decisions.decision_indices(rows).collect()}
    for k, w in enumerate(ws):
        for j in AT:
            entered, start, radial, pathlen = expected(w, j, 25.0)
            assert entry[str(k), j.junction] == (entered, start)
            assert found[str(k), j.junction] == (radial, pathlen, radial if radial is not None else pathlen)


@pytest.mark.parametrize(("walk", "at", "entered"), [([(0, 0), (1, 1), (2, 2), (3, 3)], 2, True), ([(0, 0), (0, 1), (9, 9)], 1, False), ([(2, 2), (9, 9)], 0, True), ([(9, 9), (3, 2), (2, 2)], 1, True)])
def test_entry_fixtures(spark, walk, at, entered):
    r = decisions.entries(decisions.frame(points(spark, [np.array(walk, float)]), [Junction(0, 2, 2, 1)])).first()
    assert (r["start_idx"], r["entered"]) == (at, entered)


def test_one_point_and_still_walks(spark):
    how = Decision(mode="hybrid")
    rows = decisions.frame(points(spark, [np.zeros((1, 2)), np.zeros((4, 2))]), [Junction(0, 0, 0, 5, 9)], how)
    assert [r["usable"] for r in decisions.directions(rows, how).collect()] == [False, False]
    assert {r["status"] for r in metrics.speed_through(rows, "hybrid").collect()} == {"hybrid_no_movement", "hybrid_not_reached"}


def brute_dbscan(v, eps, least):
    near = v @ v.T >= np.cos(np.radians(eps)) - 1e-12
    core, label, n = near.sum(axis=1) >= least, np.full(len(v), -1), 0
    for i in range(len(v)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                k = todo.pop()
                if label[k] < 0:
                    label[k] = n
                    if core[k]:
                        todo += [m for m in np.flatnonzero(near[k]) if label[m] < 0]
            n += 1
    return label


def test_dbscan_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, truth = [], {}
    for j in range(40):
        centre = rng.uniform(-np.pi, np.pi, rng.integers(1, 5))
        a = np.concatenate([rng.normal(c, 0.12, rng.integers(1, 14)) for c in centre] + [rng.uniform(-np.pi, np.pi, 4)])
        a[0] = np.pi - 0.01
        v = np.column_stack((np.cos(a), np.sin(a)))
        rows += [(f"{k:04d}", j, float(x), float(z)) for k, (x, z) in enumerate(v)]
        truth[j] = brute_dbscan(v, 9.0, 4)
    found = clustering.dbscan(spark.createDataFrame(rows, "trajectory string, junction int, vx double, vz double"), eps=9.0, min_samples=4).collect()
    for j, label in truth.items():
        assert [r["branch"] for r in sorted((r for r in found if r["junction"] == j), key=lambda r: r["trajectory"])] == label.tolist()


def test_silhouettes_agree(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(-3, 3, 40)
    label = rng.integers(-1, 4, 40)
    label[label == 3] = np.where(np.arange((label == 3).sum()) == 0, 3, 2)
    rows = [(str(k), 0, float(np.cos(x)), float(np.sin(x)), int(b)) for k, (x, b) in enumerate(zip(a, label))]
    df = spark.createDataFrame(rows, "trajectory string, junction int, vx double, vz double, branch int")
    v = np.column_stack((np.cos(a), np.sin(a)))
    assert clustering.silhouette(df).first()["silhouette"] == pytest.approx(clustering.silhouette_of(v, label))


def test_discovery_finds_planted_branches(spark):
    rng = np.random.default_rng(1)
    ws = [np.outer(np.arange(40), [np.cos(b), np.sin(b)]) + rng.normal(0, 0.05, (40, 2)) for b in (0.2, 2.0, -2.5) for _ in range(8)]
    for method in ("dbscan", "auto"):
        labels, centers, at = branches.discover(points(spark, ws), [Junction(0, 0, 0, 5, 20)], Decision(mode="radial"), method=method)
        got = [r["branch"] for r in sorted(labels.collect(), key=lambda r: int(r["trajectory"]))]
        assert got == [1] * 8 + [2] * 8 + [0] * 8
        assert centers.count() == 3 and at.where("reason = 'radial'").count() == 24
    again = branches.assign(decisions.directions(decisions.frame(points(spark, ws), [Junction(0, 0, 0, 5, 20)], Decision(mode="radial")), Decision(mode="radial")), centers)
    assert sorted(map(tuple, again.select("trajectory", "branch").collect())) == sorted((str(k), b) for k, b in enumerate(got))


def test_small_branches_and_rediscovery(spark):
    rows = [(str(k), 0, b) for k, b in enumerate([0] * 10 + [1] + [2] * 9 + [-1, -2])]
    found = branches.split_small(spark.createDataFrame(rows, "trajectory string, junction int, branch int"), 0.1).groupBy("branch", "is_small", "main_branch").count().collect()
    assert sorted((r["branch"], r["is_small"], r["main_branch"]) for r in found) == [(-2, False, -2), (-1, False, -1), (0, False, 0), (1, True, None), (2, False, 1)]
    east = [np.outer(np.arange(40), [1, 0.01 * k]) for k in range(6)]
    north = [np.outer(np.arange(40), [0.01 * k, 1]) for k in range(6)]
    how, at = Decision(mode="radial"), [Junction(0, 0, 0, 5, 20)]
    new = points(spark, north).withColumn("trajectory", F.concat(F.lit("n"), "trajectory"))
    known = branches.discovery(points(spark, east), at, how)
    assert [(round(r["ux"], 1), round(r["uz"], 1)) for r in known.centers.collect()] == [(1.0, 0.0)]
    assigned = branches.assign(decisions.directions(decisions.frame(new, at, how), how), known.centers)
    out = branches.rediscover(new, known, at, assigned, how)
    assert out is not None and out.centers.count() == 2
    assert branches.rediscover(points(spark, east[:3]).withColumn("trajectory", F.concat(F.lit("m"), "trajectory")), known, at, assigned, how) is None


def test_normalised_assignments(spark):
    chains = spark.createDataFrame([("3", 0, 1), ("10", 2, -1), ("x", 1, None), ("7", None, 0)], "trajectory string, branch_j0 int, branch_j1 int")
    kept, report = branches.normalized(chains, junctions=[0, 1])
    assert [r["trajectory"] for r in kept.collect()] == ["3"] and report.first()["input_rows"] == 4
    kept, report = branches.normalized(chains, known=chains.where("trajectory <> 'x'"), outliers=True)
    assert kept.count() == 3 and tuple(report.first()) == (4, 3, 1, False)
    with pytest.raises(ValueError):
        branches.normalized(chains, known=chains.where("trajectory = '3'"), strict=True)
    single = chains.select("trajectory", F.col("branch_j0").alias("branch"))
    assert branches.missing_columns(single, [0]) == [] and branches.missing_columns(chains, [0, 1, 2]) == ["branch_j2"]
    assert {r["trajectory"] for r in branches.normalized(single, junction=4)[0].collect()} == {"3", "10", "x"}
    assert {r["trajectory"]: r["number"] for r in branches.numbered(chains).collect()} == {"3": 0, "7": 1, "10": 2}


@pytest.mark.parametrize("values", [[], [1.0], [3.0, 1.0], [2.0] * 7, [float(k * k % 97) for k in range(400)], [float(k) for k in range(11)] * 3])
def test_exact_quantiles(spark, values):
    ps = [0.0, 0.05, 0.25, 0.5, 0.7, 0.9, 0.99, 1.0]
    df = spark.createDataFrame([(g, v) for g in ("a", "b") for v in values] + [("a", None)], "g string, v double")
    found = {r["g"]: list(r)[1:] for r in metrics.quantiles(df, "v", ps, "g").collect()}
    assert found == ({g: pytest.approx(np.quantile(values, ps).tolist()) for g in "ab"} if values else {})
    if values:
        assert list(metrics.quantiles(df, "v", [0.25, 0.75]).first()) == pytest.approx(np.quantile(values * 2, [0.25, 0.75]).tolist())


@pytest.mark.parametrize(("eps", "least"), [(5.0, 3), (20.0, 4), (90.0, 30), (120.0, 2)])
def test_cells_give_the_clusters_of_all_pairs(spark, eps, least):
    rng = np.random.default_rng(7)
    angles = np.concatenate((rng.normal(3.1, 0.05, 80), rng.normal(0, 0.2, 40), rng.uniform(-np.pi, np.pi, 30), np.full(9, 1.0)))
    vectors = [(f"t{k:03d}", 0, float(np.cos(a)), float(np.sin(a))) for k, a in enumerate(angles)] + [("none", 0, None, None)]
    got = {r["trajectory"]: r["branch"] for r in clustering.dbscan(spark.createDataFrame(vectors, "trajectory string, junction int, vx double, vz double"), eps=eps, min_samples=least).collect()}
    apart = np.abs(angles[:, None] - angles[None])
    near = np.minimum(apart, 2 * np.pi - apart) <= np.radians(eps) * (1 + 1e-12)
    core, label, k = near.sum(axis=1) >= least, np.full(len(angles), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = k
                    todo += np.flatnonzero(near[j] & core & (label < 0)).tolist()
            k += 1
    for i in np.flatnonzero(~core):
        label[i] = min(label[near[i] & core], default=-1)
    assert got.pop("none") == -1 and [got[f"t{i:03d}"] for i in range(len(angles))] == label.tolist()
