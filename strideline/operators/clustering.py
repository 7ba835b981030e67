"""Clusters of unit direction vectors, junction by junction.

By density, clusters are islands of core angles. They follow from a summary of the circle's cells, which is a table of a
bounded number of rows for each junction: summaries of parts of the data merge, so new directions need no old ones. K-means
keeps only its centres on the driver: each round is one aggregation of all vectors, for all junctions and numbers of
clusters at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.geometry import direction, length
from strideline.operators.decisions import KEYS
from strideline.operators.ranks import ranked
from strideline.sources.scratch import settled

#: Cells of the circle in one eps.
CELLS_PER_EPS = 8
_END = "array<struct<angle:double,trajectory:string,vx:double,vz:double>>"


def _cells(eps: float) -> tuple[float, int]:
    """The reach of eps degrees in radians, and the number of cells."""
    if not 0 < eps <= 120:
        raise ValueError("eps must be over 0 and at most 120 degrees")
    reach = math.radians(eps) * (1 + 1e-12)
    return reach, math.ceil(2 * math.pi / (reach / CELLS_PER_EPS))


def celled(vectors: DataFrame, eps: float = 15.0) -> DataFrame:
    """vectors (vx, vz and others) with angle and cell, an eighth of eps of the circle; null without a direction."""
    cells = _cells(eps)[1]
    angle = direction(F.col("vx"), F.col("vz"))
    cell = F.when(angle.isNotNull(), F.least(F.floor((angle + math.pi) / (2 * math.pi / cells)), F.lit(cells - 1))).cast("int")
    return vectors.withColumns({"angle": angle, "cell": cell})


def summary(vectors: DataFrame, min_samples: int = 5) -> DataFrame:
    """junction, cell, n, first (trajectory), sx, sz (the sums of its vectors) and ends, the min_samples least and greatest directions of each cell of celled() vectors: what clusters() needs.

    Only those directions are ever ranked, of each task's rows first, so a crowded cell costs a task no more than others.
    """
    named = vectors.where("angle is not null").select("junction", "cell", F.col("trajectory").cast("string").alias("trajectory"), "angle", "vx", "vz")
    heads = named.groupBy("junction", "cell").agg(F.count("*").alias("n"), F.min("trajectory").alias("first"), F.sum("vx").alias("sx"), F.sum("vz").alias("sz"))
    w = Window.partitionBy("junction", "cell")
    ends = [named.withColumn("_k", F.row_number().over(w.orderBy(*order))).where(F.col("_k") <= min_samples).drop("_k") for order in ((F.asc("angle"), F.asc("trajectory")), (F.desc("angle"), F.asc("trajectory")))]
    heads = heads.select("junction", "cell", "n", "first", "sx", "sz", F.lit(None).cast(_END).alias("ends"))
    empty = {"n": "long", "first": "string", "sx": "double", "sz": "double"}
    both = ends[0].unionByName(ends[1]).select("junction", "cell", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], F.array(F.struct("angle", "trajectory", "vx", "vz")).alias("ends"))
    return _gathered(heads.unionByName(both), min_samples)


def merged(a: DataFrame, b: DataFrame, min_samples: int = 5) -> DataFrame:
    """The summary of the directions of two summaries with the same eps; a direction of both counts twice."""
    return _gathered(a.unionByName(b), min_samples)


def _gathered(parts: DataFrame, k: int) -> DataFrame:
    """One row for each junction and cell; a cell of a part has 2 k directions at most."""
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ends"))))
    g = parts.groupBy("junction", "cell").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("sx").alias("sx"), F.sum("sz").alias("sz"), every.alias("_all"))
    short = F.size("_all") <= 2 * k
    ends = F.when(short, F.col("_all")).otherwise(F.concat(F.slice("_all", 1, k), F.slice("_all", -k, k)))
    return g.select("junction", "cell", "n", "first", "sx", "sz", ends.alias("ends"))


def clusters(cells: DataFrame, *, eps: float = 15.0, min_samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """Each cell's cluster (whole) or those of its trajectories (single), by junction and cell; and the clusters' centres: junction, branch, ux, uz.

    A direction is core with min_samples or more (itself included) within eps degrees; cores within eps of one another
    are one cluster, and another direction belongs to the cluster with a core within eps whose first core comes first in
    trajectory order. Clusters are numbered by the angles of their centres, the normalised means of their directions; rank
    is a cluster's number by its first core.

    All directions of a cell are core where the cells that lie whole within eps hold min_samples; elsewhere a cell holds
    fewer than min_samples directions. So a junction's clusters follow from its summary(), a few thousand directions at
    any size, which is one group.
    """
    reach, size = _cells(eps)
    schema = "junction int, cell int, whole int, single array<struct<trajectory:string,label:int>>, branch int, rank int, ux double, uz double"

    def label(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _clusters(group, reach, size, min_samples).assign(junction=key[0])[["junction", "cell", "whole", "single", "branch", "rank", "ux", "uz"]].astype({c: "Int32" for c in ("cell", "whole", "branch", "rank")})

    found = cells.groupBy("junction").applyInPandas(label, schema)
    return found.where("cell is not null").select("junction", "cell", "whole", "single"), found.where("branch is not null").select("junction", "branch", "ux", "uz", "rank")


def _clusters(rows: pd.DataFrame, reach: float, cells: int, least: int) -> pd.DataFrame:
    """clusters() of one junction: a row for each cell, and one for each cluster."""
    n, first = dict(zip(rows["cell"], rows["n"].astype(int))), dict(zip(rows["cell"], rows["first"]))
    ends = dict(zip(rows["cell"], rows["ends"]))
    sums = dict(zip(rows["cell"], rows[["sx", "sz"]].to_numpy()))
    angles = {c: np.array([e["angle"] for e in es]) for c, es in ends.items()}
    sure, most = int(reach / (2 * math.pi / cells)) - 1, math.ceil(reach / (2 * math.pi / cells))
    apart = lambda a, b: np.minimum(np.abs(a - b), 2 * math.pi - np.abs(a - b))
    around = lambda c, lo, hi: {(c + s * d) % cells for d in range(lo, hi + 1) for s in (-1, 1)}
    inner = {c: sum(n.get(k, 0) for k in around(c, 0, sure)) for c in n}
    points: list[tuple] = []  # cell, trajectory (None: the whole cell), angle, first trajectory of a core
    loose: list[tuple] = []
    for c in n:
        if inner[c] >= least:
            points += [(c, None, a, first[c]) for a in (angles[c].min(), angles[c].max())]
            continue
        for e in ends[c]:
            near = inner[c] + sum(int((apart(angles[k], e["angle"]) <= reach).sum()) for k in around(c, sure + 1, most) if k in angles)
            (points if near >= least else loose).append((c, e["trajectory"], e["angle"], e["trajectory"]))
    points.sort(key=lambda p: p[2])
    at = np.array([p[2] for p in points])
    island = np.concatenate(([0], np.cumsum(np.diff(at) > reach))) if len(at) else np.zeros(0, int)
    if len(at) and at[0] + 2 * math.pi - at[-1] <= reach:
        island[island == island[-1]] = 0
    start = {k: min(p[3] for p, i in zip(points, island, strict=True) if i == k) for k in set(island.tolist())}
    rank = {k: place for place, k in enumerate(sorted(start, key=start.get))}
    out = {(p[0], p[1]): rank[i] for p, i in zip(points, island.tolist(), strict=True)}
    for c, t, a, _ in loose:
        out[c, t] = min((rank[i] for i in island[apart(at, a) <= reach].tolist()), default=-1)
    total = np.zeros((len(rank), 2))
    for (c, t), k in out.items():
        if k >= 0:
            total[k] += sums[c] if t is None else next((e["vx"], e["vz"]) for e in ends[c] if e["trajectory"] == t)
    size = np.hypot(*total.T)
    unit = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], [1.0, 0.0])
    order = np.lexsort((np.arange(len(rank)), np.arctan2(unit[:, 1], unit[:, 0]))).tolist()
    number = {k: b for b, k in enumerate(order)} | {-1: -1}
    one: dict[int, list] = {}
    for (c, t), k in out.items():
        if t is not None:
            one.setdefault(c, []).append((t, number[k]))
    whole = [(c, number[out[c, None]] if (c, None) in out else None, one.get(c, []), None, None, None, None) for c in n]
    return pd.DataFrame([*whole, *((None, None, None, b, k, *unit[k]) for b, k in enumerate(order))], columns=["cell", "whole", "single", "branch", "rank", "ux", "uz"])


def labelled(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """celled() vectors with branch, by the labels of clusters(): -1 for noise and without a direction. Cells are few, but a crowded one may hold most vectors; the labels are broadcast or the join is split as Spark finds their size."""
    named = labels.withColumnsRenamed({"whole": "_whole", "single": "_single"})
    out = vectors.join(named, ["junction", "cell"], "left")
    own = F.get(F.filter("_single", lambda p: p["trajectory"] == F.col("trajectory").cast("string")), F.lit(0))["label"]
    return out.withColumn("branch", F.coalesce("_whole", own, F.lit(-1)).cast("int")).drop("_whole", "_single")


def dbscan(vectors: DataFrame, *, eps: float = 15.0, min_samples: int = 5) -> DataFrame:
    """vectors (trajectory, junction, vx, vz and any other columns) with branch: the clusters() of their directions, numbered by their first cores; -1 for noise and for rows without a direction."""
    taken = [c for c in ("angle", "cell") if c in vectors.columns]  # columns of these names come back at the end
    plain = vectors.withColumnsRenamed({c: f"_own_{c}" for c in taken})
    rows = settled(celled(plain, eps), "directions")
    labels, centers = clusters(summary(rows, min_samples), eps=eps, min_samples=min_samples)
    found = labelled(rows, labels).withColumnRenamed("branch", "_turn")
    ranks = centers.select("junction", F.col("branch").alias("_turn"), "rank")
    return found.join(ranks, ["junction", "_turn"], "left").select(*[F.col(f"_own_{c}" if c in taken else c).alias(c) for c in vectors.columns], F.coalesce("rank", F.lit(-1)).cast("int").alias("branch"))


def silhouette_of(v: np.ndarray, label: np.ndarray) -> float:
    """Mean cosine silhouette from the clusters' vector sums; a lone member's own distance is 0, and one cluster scores 0."""
    names = np.unique(label[label >= 0])
    if len(names) < 2:
        return 0.0
    v, label = v[label >= 0], label[label >= 0]
    sums, sizes = np.array([v[label == c].sum(axis=0) for c in names]), np.array([(label == c).sum() for c in names])
    own = np.searchsorted(names, label)
    apart = 1 - v @ sums.T / sizes
    rows = np.arange(len(v))
    a = np.where(sizes[own] > 1, (sizes[own] - (v * sums[own]).sum(axis=1)) / np.maximum(1, sizes[own] - 1), 0.0)
    apart[rows, own] = np.inf
    b = apart.min(axis=1)
    top = np.maximum(a, b)
    return float(np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0).mean())


def _starts(sizes: dict[int, int], ks: Iterable[int], seeds: dict[int, int]) -> dict[tuple[int, int], list[int]]:
    """The places, in trajectory order, of the vectors that a junction's k clusters start as."""
    return {(j, k): np.random.default_rng(seeds[j]).choice(n, k, replace=False).tolist() for j, n in sizes.items() for k in ks if k <= n}


def _nearest(k: Column | str = "centers") -> Column:
    """The index of the nearest of some centres, the first of equals."""
    apart = lambda c: (F.col("vx") - c["x"]) * (F.col("vx") - c["x"]) + (F.col("vz") - c["z"]) * (F.col("vz") - c["z"])
    return F.array_min(F.transform(k, lambda c, i: F.struct(apart(c).alias("d"), i.alias("i"))))["i"]


def _beside(vectors: DataFrame, centers: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """vectors beside each list of centres of their junction: k, centers."""
    lists = [(j, k, [(float(x), float(z)) for x, z in c]) for (j, k), c in centers.items()]
    table = vectors.sparkSession.createDataFrame(lists, "junction int, k int, centers array<struct<x:double,z:double>>")
    return vectors.join(F.broadcast(table), "junction")  # a few numbers for each junction, which the driver holds


def lloyd(vectors: DataFrame, centers: dict[tuple[int, int], np.ndarray], steps: int = 100) -> dict[tuple[int, int], np.ndarray]:
    """Lloyd's rounds of vectors (junction, vx, vz) from the centres of each (junction, k), until they stay or after so many steps; a centre without vectors stays. One aggregation a round serves all that still move."""
    done, moving = {}, dict(centers)
    for _ in range(steps):
        if not moving:
            break
        each = _beside(vectors, moving).select("junction", "k", _nearest().alias("i"), "vx", "vz")
        new = {key: c.copy() for key, c in moving.items()}
        for r in each.groupBy("junction", "k", "i").agg(F.avg("vx").alias("x"), F.avg("vz").alias("z")).collect():  # a row for each centre
            new[r["junction"], r["k"]][r["i"]] = r["x"], r["z"]
        done |= {key: c for key, c in new.items() if np.allclose(c, moving[key])}
        moving = {key: c for key, c in new.items() if key not in done}
    return done | moving


def _silhouettes(vectors: DataFrame, centers: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], float]:
    """silhouette() of each list of centres."""
    each = _beside(vectors, centers).select("junction", "k", _nearest().alias("i"), "vx", "vz")
    sums = each.groupBy("junction", "k", "i").agg(F.sum("vx").alias("sx"), F.sum("vz").alias("sz"), F.count("*").alias("n")).collect()  # a row for each centre
    lists: dict[tuple[int, int], list] = {}
    for r in sums:
        lists.setdefault((r["junction"], r["k"]), []).append((r["i"], r["sx"], r["sz"], r["n"]))
    table = vectors.sparkSession.createDataFrame([(j, k, v) for (j, k), v in lists.items()], "junction int, k int, sums array<struct<i:int,sx:double,sz:double,n:long>>")
    both = each.join(F.broadcast(table), ["junction", "k"])  # as _beside()
    dot = lambda s: F.col("vx") * s["sx"] + F.col("vz") * s["sz"]
    own = F.filter("sums", lambda s: s["i"] == F.col("i"))[0]
    a = F.when(own["n"] > 1, (own["n"] - dot(own)) / F.greatest(own["n"] - 1, F.lit(1))).otherwise(0.0)
    b = F.array_min(F.transform(F.filter("sums", lambda s: s["i"] != F.col("i")), lambda s: 1 - dot(s) / s["n"]))
    s = F.when(F.col("b").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.when(F.greatest("a", "b") > 0, F.greatest("a", "b")))
    found = both.select("junction", "k", a.alias("a"), b.alias("b")).groupBy("junction", "k").agg(F.avg(s).alias("s"))
    return {(r["junction"], r["k"]): r["s"] for r in found.collect()}


def merged_centers(centers: np.ndarray, degrees: float) -> list[int]:
    """The cluster that each cluster is folded into: the first one kept whose centre is within degrees of its own."""
    kept: list[tuple[np.ndarray, int]] = []
    out = []
    for m in centers:
        m = m / (np.linalg.norm(m) or 1)
        home = next((k for u, k in kept if math.degrees(math.acos(float(np.clip(u @ m, -1, 1)))) < degrees), None)
        if home is None:
            kept.append((m, home := len(kept)))
        out.append(home)
    return out


def kmeans(vectors: DataFrame, *, k: int = 3, k_range: tuple[int, int] | None = None, seed: int | dict[int, int] = 0, min_separation: float = 12.0) -> DataFrame:
    """trajectory, junction, vx, vz, branch: k-means of the directions, or the k of k_range with the best silhouette; clusters nearer than min_separation degrees are merged.

    The clusters start as k vectors drawn by seed (one for all junctions, or of each) from the junction's in the order of
    their trajectories. k is at most the number of directions; without a k of the range under it, 3. Every round
    aggregates all vectors; the driver and each task hold the centres alone.
    """
    rows = ranked(vectors.select(*KEYS, "vx", "vz"), "junction", "trajectory", as_="_place")
    rows = settled(rows, "vectors")
    known = {r["junction"]: (r["n"], r["first"]) for r in rows.groupBy("junction").agg(F.count("*").alias("n"), F.min("_place").alias("first")).collect()}
    sizes, seeds = {j: n for j, (n, _) in known.items()}, {j: seed[j] if isinstance(seed, dict) else seed for j in known}
    tried = {j: [c for c in range(k_range[0], k_range[1] + 1) if c < n] if k_range else [] for j, n in sizes.items()}
    starts = {}
    for j, n in sizes.items():
        starts |= _starts({j: n}, tried[j] or [min(3 if k_range else k, n)], seeds)
    spots = [(j, c, i, known[j][1] + p) for (j, c), places in starts.items() for i, p in enumerate(places)]
    wanted = rows.sparkSession.createDataFrame(spots, "_j int, k int, i int, _place long")
    centers = {key: np.zeros((len(p), 2)) for key, p in starts.items()}
    for r in rows.join(F.broadcast(wanted), "_place").select("_j", "k", "i", "vx", "vz").collect():  # one for each centre
        centers[r["_j"], r["k"]][r["i"]] = r["vx"], r["vz"]
    moving = rows.select("junction", "vx", "vz")
    centers = lloyd(moving, centers) if centers else centers
    several = {key: c for key, c in centers.items() if len(tried[key[0]]) > 1}
    scores = _silhouettes(moving, several) if several else {}
    best = {}
    for j, c in sorted(centers):
        if j not in best or scores.get((j, c), -2.0) > scores.get((j, best[j]), -2.0):
            best[j] = c
    chosen = {(j, c): centers[j, c] for j, c in best.items()}
    each = _beside(rows, chosen).withColumn("i", _nearest()) if chosen else rows.withColumns({"k": F.lit(0), "i": F.lit(0)})
    means: dict[int, dict[int, tuple]] = {}
    for r in each.groupBy("junction", "i").agg(F.avg("vx").alias("x"), F.avg("vz").alias("z")).collect():  # one for each centre
        means.setdefault(r["junction"], {})[r["i"]] = (r["x"], r["z"])
    homes = [(j, i, home) for j, m in means.items() for i, home in zip(sorted(m), merged_centers(np.array([m[i] for i in sorted(m)]), min_separation))]
    table = rows.sparkSession.createDataFrame(homes, "junction int, i int, branch int")
    return each.join(F.broadcast(table), ["junction", "i"]).select(*KEYS, "vx", "vz", "branch")


def by_angle(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labels with branches numbered by their centres' angles (noise stays -1), and the centres: junction, branch, ux, uz (the normalised mean, (1, 0) if it is null)."""
    labels = settled(labels, "labels")
    g = labels.where("branch >= 0").groupBy("junction", "branch").agg(F.avg("vx").alias("mx"), F.avg("vz").alias("mz"))
    size = length(F.col("mx"), F.col("mz"))
    g = g.select("junction", F.col("branch").alias("old"), F.coalesce(F.col("mx") / F.when(size > 0, size), F.lit(1.0)).alias("ux"), F.coalesce(F.col("mz") / F.when(size > 0, size), F.lit(0.0)).alias("uz"))
    g = g.withColumn("branch", (F.row_number().over(Window.partitionBy("junction").orderBy(direction(F.col("ux"), F.col("uz")), "old")) - 1).cast("int"))
    named = labels.withColumnRenamed("branch", "old").join(g.select("junction", "old", F.col("branch").alias("_new")), ["junction", "old"], "left")
    return named.withColumn("branch", F.coalesce("_new", F.lit(-1))).select(*labels.columns), g.select("junction", "branch", "ux", "uz")


def silhouette(labels: DataFrame) -> DataFrame:
    """junction, silhouette: the mean cosine silhouette of labelled unit vectors, in closed form from the clusters' sums (linear in rows); noise is skipped, one cluster gives 0."""
    rows = labels.where("branch >= 0")
    sums = rows.groupBy("junction", "branch").agg(F.sum("vx").alias("sx"), F.sum("vz").alias("sz"), F.count("*").alias("n"))
    pairs = rows.withColumnRenamed("branch", "own").join(sums, "junction")
    dot = F.col("vx") * F.col("sx") + F.col("vz") * F.col("sz")
    same = F.col("branch") == F.col("own")
    a = F.max(F.when(same, F.when(F.col("n") > 1, (F.col("n") - dot) / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(0.0)))
    b = F.min(F.when(~same, 1 - dot / F.col("n")))
    each = pairs.groupBy(*KEYS).agg(a.alias("a"), b.alias("b"))
    s = F.when(F.col("b").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.when(F.greatest("a", "b") > 0, F.greatest("a", "b")))
    return each.groupBy("junction").agg(F.avg(s).alias("silhouette"))
