"""K-means against numpy's rounds from the same starts, mergeable summaries against a full rerun, places and densities against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.operators import branches, clustering, flows, metrics
from strideline.operators.ranks import ranked
from strideline.plans.params import Decision, Junction
from strideline.sources.points import FIELDS


def lloyd(v, centers, steps=100):
    for _ in range(steps):
        label = ((v[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([v[label == c].mean(axis=0) if (label == c).any() else centers[c] for c in range(len(centers))])
        done, centers = np.allclose(new, centers), new
        if done:
            break
    return ((v[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)


def merged(v, label, degrees):
    kept, out = [], label.copy()
    for c in np.unique(label):
        m = v[label == c].mean(axis=0)
        m = m / np.linalg.norm(m)
        home = next((k for u, k in kept if np.degrees(np.arccos(np.clip(u @ m, -1, 1))) < degrees), None)
        if home is None:
            kept.append((m, home := len(kept)))
        out[label == c] = home
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    """Directions of junctions 0 (three groups), 1 (two near ones), 2 (two vectors) and 3 (one)."""
    rng = np.random.default_rng(3)
    angles = {0: np.concatenate([rng.normal(c, 0.15, 40) for c in (0.3, 2.4, -1.9)]), 1: np.concatenate((rng.normal(1, 0.05, 30), rng.normal(1.15, 0.05, 30), rng.normal(-2, 0.1, 20))), 2: np.array([0.0, 2.0]), 3: np.array([1.0])}
    rows = [(f"t{k:03d}", j, float(np.cos(x)), float(np.sin(x))) for j, a in angles.items() for k, x in enumerate(rng.permutation(a))]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    return spark.createDataFrame(rows, "trajectory string, junction int, vx double, vz double").repartition(5), rows


@pytest.mark.parametrize(("k", "k_range", "seed", "apart"), [(3, None, 0, 12.0), (5, None, 2, 0.0), (2, (2, 6), 1, 12.0), (3, (2, 4), 7, 30.0), (1, None, 0, 12.0)])
def test_kmeans_equals_numpy_from_the_same_starts(vectors, k, k_range, seed, apart):
    df, rows = vectors
    found = {(r["trajectory"], r["junction"]): r["branch"] for r in clustering.kmeans(df, k=k, k_range=k_range, seed=seed, min_separation=apart).collect()}
    assert len(found) == len(rows)
    for j in range(4):
        mine = sorted(r for r in rows if r[1] == j)
        v = np.array([r[2:] for r in mine])
        start = lambda c: v[np.random.default_rng(seed).choice(len(v), c, replace=False)]  # noqa: B023, E731
        tried = [c for c in range(k_range[0], k_range[1] + 1) if c < len(v)] if k_range else []
        scores = [clustering.silhouette_of(v, lloyd(v, start(c))) for c in tried]
        best = tried[int(np.argmax(scores))] if tried else min(3 if k_range else k, len(v))
        assert [found[r[0], j] for r in mine] == merged(v, lloyd(v, start(best)), apart).tolist()


def test_no_group_holds_a_junctions_vectors(vectors):
    plan = clustering.kmeans(vectors[0], k_range=(2, 4))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Window" not in plan
    assert clustering.kmeans(vectors[0].limit(0)).count() == 0


def test_merged_centers():
    unit = lambda *degrees: np.array([[np.cos(np.radians(d)), np.sin(np.radians(d))] for d in degrees])
    assert clustering.merged_centers(unit(0, 8, 16, 90), 12.0) == [0, 0, 1, 2]  # by the first kept, not by chains
    assert clustering.merged_centers(unit(0, 8, 16, 90), 0.0) == [0, 1, 2, 3]
    assert clustering.merged_centers(unit(179, -179) * 0.2, 12.0) == [0, 0]


@pytest.mark.parametrize(("eps", "least"), [(9.0, 4), (30.0, 6)])
def test_summaries_merge(spark, eps, least):
    rng = np.random.default_rng(6)
    rows = [(f"t{j}-{k:04d}", j, float(np.cos(a)), float(np.sin(a))) for j in range(8) for k, a in enumerate(np.concatenate((rng.normal(rng.uniform(-3, 3), 0.2, 60), rng.uniform(-np.pi, np.pi, 25))))]
    rows = [rows[k] for k in rng.permutation(len(rows))] + [("none", 0, None, None)]
    df = clustering.celled(spark.createDataFrame(rows, "trajectory string, junction int, vx double, vz double"), eps).persist()
    part = F.pmod(F.xxhash64("trajectory"), F.lit(3))
    summed = clustering.summary(df.where(part == 0), least)
    for k in (1, 2):
        summed = clustering.merged(summed, clustering.summary(df.where(part == k), least), least)
    said = lambda s: [sorted(map(tuple, clustering.labelled(df, clustering.clusters(s, eps=eps, min_samples=least)[0]).select("trajectory", "junction", "branch").collect())), sorted((r["junction"], r["branch"], round(r["ux"], 9), round(r["uz"], 9)) for r in clustering.clusters(s, eps=eps, min_samples=least)[1].collect())]
    whole = said(clustering.summary(df, least))
    assert said(summed) == whole and len(whole[1]) > 8
    turns = clustering.dbscan(df.select("trajectory", "junction", "vx", "vz"), eps=eps, min_samples=least)  # the same sets, numbered otherwise
    both = {(r["junction"], r["branch"]) for r in turns.collect()}
    assert len(both) == len({x[1:] for x in whole[0]})
    df.unpersist()


def walks(spark, angles, prefix, path):
    rows = [(f"{prefix}{k}", i, float(i * np.cos(a)), float(i * np.sin(a)), float(i)) for k, a in enumerate(angles) for i in range(40)]
    df = spark.createDataFrame(rows, "trajectory string, idx int, x double, z double, t double")
    df.withColumns({c: F.lit(None).cast("double") for c in FIELDS if c not in df.columns}).write.parquet(path)
    return spark.read.parquet(path)


def test_rediscovery_equals_a_full_rerun_without_the_old_points(spark, tmp_path):
    rng = np.random.default_rng(4)
    at, how = [Junction(0, 0, 0, 5, 20), Junction(1, 300, 300, 4, 9)], Decision(mode="radial")
    old = walks(spark, [*rng.normal(0, 0.05, 9), *rng.normal(2, 0.05, 9), 1.1, 1.2], "o", f"{tmp_path}/old")
    new = walks(spark, [*rng.normal(1.15, 0.05, 6), *rng.normal(-2, 0.05, 7)], "n", f"{tmp_path}/new")
    known = branches.discovery(old, at, how)
    from strideline.operators.decisions import directions, scan

    assigned = branches.assign(directions(scan(new, at, how), how), known.centers)
    again, whole = branches.rediscover(new, known, at, assigned, how), branches.discovery(old.unionByName(new), at, how)
    said = lambda d: (sorted(map(tuple, d.assigned.collect())), sorted((r["junction"], r["branch"], round(r["ux"], 9), round(r["uz"], 9)) for r in d.centers.collect()), sorted(map(str, d.decided.collect())))
    assert said(again) == said(whole) and whole.centers.count() == 4
    for df in (again.assigned, again.centers, again.decided):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"{tmp_path}/old" not in plan
    third = walks(spark, rng.normal(-1, 0.05, 6), "x", f"{tmp_path}/third")
    assigned = branches.assign(directions(scan(third, at, how), how), again.centers)
    assert branches.rediscover(third, again, at, assigned, how).centers.count() == 5  # goes on from the merged state


def test_chain_of_discovered_branches(spark, tmp_path):
    at, how = [Junction(4, 0, 0, 5, 20), Junction(9, 300, 300, 4, 9)], Decision(mode="radial")
    p = walks(spark, np.concatenate([np.full(6, a) + np.linspace(0, 0.02, 6) for a in (0.2, 2.0)]), "w", f"{tmp_path}/p")
    for method in ("dbscan", "kmeans"):
        table, centers, spots = branches.discover_chain(p, at, how, method=method, k=2)
        assert sorted(map(tuple, table.collect())) == sorted((f"w{k}", k // 6, -2) for k in range(12))
        assert centers.count() == 2 and spots.where("reason = 'radial'").count() == 12


def test_places_with_far_off_ids(spark):
    ids = [*range(20_000), 9 * 10**18, -(9 * 10**18)]
    df = spark.createDataFrame([(str(i),) for i in np.random.default_rng(0).permutation(ids).tolist()] + [("x",)], "trajectory string")
    found = branches.numbered(df)
    got = {r["trajectory"]: r["number"] for r in found.collect()}
    assert got == {str(i): n for n, i in enumerate(sorted(ids))}
    sizes = [r["count"] for r in ranked(df.select(F.col("trajectory").try_cast("long").alias("id")).where("id is not null"), "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 12_000  # no task has them all
    ties = spark.createDataFrame([(1, "a"), (1, "b"), (0, "c"), (None, "d")], "k int, v string")
    assert sorted((r["place"], r["k"]) for r in ranked(ties, "k").collect()) == [(0, None), (1, 0), (2, 1), (3, 1)]
    assert ranked(ties.limit(0), "k").count() == 0


@pytest.mark.parametrize("kind", ["normal", "outliers", "two"])
def test_density_sums_over_all_values(spark, kind):
    rng = np.random.default_rng(5)
    v = {"normal": rng.normal(3, 2, 4000), "outliers": np.concatenate((rng.normal(0, 0.01, 3000), [1e4, -50.0])), "two": np.array([1.0, 5.0])}[kind]
    found = metrics.density(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double"), "v", 50).orderBy("at").collect()
    h = 1.06 * v.std(ddof=1) * len(v) ** -0.2
    at = np.linspace(*np.quantile(v, [0.01, 0.99]), 50)
    want = np.exp(-0.5 * ((at[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
    peak = 1 / (h * np.sqrt(2 * np.pi))
    assert [r["at"] for r in found] == pytest.approx(at.tolist()) and np.abs(np.array([r["density"] for r in found]) - want).max() < 1e-11 * peak
    assert metrics.density(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").count() == 0


def test_next_choice(spark):
    moves = [(1, 2, 3, 6, 60.0), (1, 2, 4, 4, 40.0), (5, 2, 3, 1, 50.0), (5, 2, 1, 1, 50.0)]
    second = spark.createDataFrame(moves, "origin int, via int, dest int, n int, percent double")
    assert flows.next_choice(second, 1, 2) == ("J3", 0.6) and flows.next_choice(second, 5, 2) == ("J1", 0.5)
    assert flows.next_choice(second, 2, 1) == ("Unknown", 0.0)


def test_branch_directions_fall_back_to_centres(spark):
    a = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 0, -1)], "trajectory string, junction int, branch int")
    p = spark.createDataFrame([("a", 0, 3, 11.0, 5.0), ("b", 0, None, None, None)], "trajectory string, junction int, decision_idx int, intercept_x double, intercept_z double")
    at = spark.createDataFrame([(0, 1.0, 5.0)], "junction int, cx double, cz double")
    centers = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 0.0, -1.0), (0, 2, 0.6, 0.8)], "junction int, branch int, ux double, uz double")
    assert [tuple(r) for r in branches.branch_directions(a, p, at).collect()] == [(0, 0, 1.0, 0.0, 0)]
    found = {r["branch"]: (r["ux"], r["uz"], r["turn"]) for r in branches.branch_directions(a, p, at, centers).collect()}
    assert found == {0: (1.0, 0.0, 1), 1: (0.0, -1.0, 2), 2: (0.6, 0.8, 0)}
