"""Points against many discs and zones through the grid, against numpy; direct connections against a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.operators import flows, grid, metrics
from strideline.plans.params import Junction, Zone
from strideline.sources.points import FIELDS


def points(spark, xy):
    rows = [(str(k // 25), k % 25, float(x), float(z)) for k, (x, z) in enumerate(xy)] + [("n", 0, None, 1.0)]
    df = spark.createDataFrame(rows, "trajectory string, idx int, x double, z double")
    return df.withColumns({c: F.lit(None).cast("double") for c in FIELDS if c not in df.columns})


def scattered(n, seed=0):
    """Discs of very different sizes, some within others, some that only touch a cell's edge."""
    rng = np.random.default_rng(seed)
    r = np.concatenate((rng.uniform(0.5, 3, n - 4), [40.0, 90.0, 1e-6, 2.0]))
    xy = np.concatenate((rng.uniform(-100, 100, (n - 1, 2)), [[0.0, 0.0]]))
    return [Junction(int(k) + 5, float(x), float(z), float(a), float(a) * 1.5) for k, ((x, z), a) in enumerate(zip(xy, r))]


@pytest.mark.parametrize("n", [10, 10_400])
def test_first_junction_that_holds_a_point(spark, n):
    at, rng = scattered(n), np.random.default_rng(1)
    xy = np.concatenate((rng.uniform(-150, 150, (400, 2)), [[j.cx + j.reach, j.cz] for j in at[:100]], [[2.0, 0.0], [0.0, 0.0]]))
    found = grid.holding(points(spark, xy), grid.of_junctions(at))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r["trajectory"], r["idx"]): [s["junction"] for s in r["_held"] or []] for r in found.collect()}
    cx, cz, reach = (np.array([getattr(j, c) for j in at]) for c in ("cx", "cz", "reach"))
    for k, (x, z) in enumerate(xy):
        want = [at[i].junction for i in np.flatnonzero(np.sqrt((x - cx) ** 2 + (z - cz) ** 2) <= reach)]
        assert got[str(k // 25), k % 25] == want
    assert got["n", 0] == []


def test_visits_are_the_same_through_the_grid(spark, monkeypatch):
    rng = np.random.default_rng(2)
    xy = np.cumsum(rng.normal(0, 6, (1500, 2)), axis=0) % 120 - 60
    at = scattered(30, 4)
    zones = [Zone(f"Z{k}", circle=(float(x), float(z), 9.0), tolerance=0.5) if k % 2 else Zone(f"Z{k}", rectangle=(float(x), float(x) + 14, float(z) - 3, float(z) + 11), tilt=17.0 * k, tolerance=1.0) for k, (x, z) in enumerate(rng.uniform(-60, 60, (12, 2)))] + [Zone("none")]
    p = points(spark, xy).where("x is not null").persist()
    said = lambda df: sorted(map(tuple, df.collect()), key=str)
    plain = [said(flows.visits(p, at)), said(flows.visits_with_zones(p, at[:5], zones, zones[:3])), said(flows.zone_points(p, zones, zones[4:]))]
    monkeypatch.setattr(flows, "FEW", 0)
    assert [said(flows.visits(p, at)), said(flows.visits_with_zones(p, at[:5], zones, zones[:3])), said(flows.zone_points(p, zones, zones[4:]))] == plain
    held = grid.holding(p, grid.of_zones(zones), zones)
    names = {(r["trajectory"], r["idx"]): [s["name"] for s in r["_held"] or []] for r in held.collect()}
    for z in zones:
        inside = {(r["trajectory"], r["idx"]) for r in p.where(metrics.in_zone(z)).collect()}
        assert inside == {k for k, v in names.items() if z.name in v}
    p.unpersist()


def test_near_points_of_each_disc(spark):
    at, xy = scattered(40, 6), np.random.default_rng(3).uniform(-60, 60, (300, 2))
    found = grid.near(points(spark, xy), grid.of_junctions(at, "ring"))
    got = {(int(r["trajectory"]) * 25 + r["idx"], r["junction"]): r["dist"] for r in found.collect()}
    want = {(k, j.junction): float(np.sqrt((x - j.cx) ** 2 + (z - j.cz) ** 2)) for k, (x, z) in enumerate(xy) for j in at if np.sqrt((x - j.cx) ** 2 + (z - j.cz) ** 2) <= j.ring}
    assert got == pytest.approx(want)
    assert grid.holding(points(spark, xy), []).where("_held is not null").count() == 0


def plain_direct(walks, at, counted):
    out = {}
    for k, w in enumerate(walks):
        dist = {j.junction: np.sqrt((w[:, 0] - j.cx) ** 2 + (w[:, 1] - j.cz) ** 2) for j in at}
        near = {j.junction: np.flatnonzero(dist[j.junction] <= 2 * j.r) for j in at}
        touch = [(i, j.junction) for j in at for i in np.flatnonzero(dist[j.junction] <= j.r)]
        for o in near:
            for d in near:
                if o != d and len(near[o]) and len(near[d]) and {(k, o), (k, d)} <= counted and near[o][-1] < near[d][0]:
                    if not any(t not in (o, d) and near[o][-1] <= i < near[d][0] for i, t in touch):
                        out[o, d] = out.get((o, d), 0) + 1
    return out


def test_direct_connections_equal_a_plain_search(spark):
    rng = np.random.default_rng(9)
    at = [Junction(k, float(x), float(z), float(r)) for k, (x, z, r) in enumerate(zip(*rng.uniform(-40, 40, (2, 9)), rng.uniform(3, 9, 9)))]
    walks = [np.cumsum(rng.normal(0, 9, (40, 2)), axis=0) % 100 - 50 for _ in range(150)]
    rows = [(str(k), i, float(x), float(z)) for k, w in enumerate(walks) for i, (x, z) in enumerate(w)]
    counted = {(k, j.junction) for k in range(150) for j in at if (k * 7 + j.junction) % 5}
    p = spark.createDataFrame(rows, "trajectory string, idx int, x double, z double")
    assigned = spark.createDataFrame([(str(k), j, 0 if (k, j) in counted else -1) for k in range(150) for j in range(9)], "trajectory string, junction int, branch int")
    found = flows.direct(p, at, assigned)
    got = {(r["origin"], r["dest"]): r["n"] for r in found.collect()}
    assert got == plain_direct(walks, at, counted) and len(got) > 20
    assert sum(r["share"] for r in found.collect()) == pytest.approx(1.0)
