"""Boosted trees and forests for several classes, many models in the same Spark jobs.

Features are put into bins once, by quantiles of each group of rows (a junction and distance, say). A model is a group with
one fold held out, or none. Trees grow level by level: tasks send every row down the trees so far and add up what the
splits are judged by, for each tree, node, feature and bin; these histograms are summed by a shuffle, and one group for
each tree finds its nodes' best splits. So a level is one job for all models, and for all trees of a forest; the number
of jobs does not depend on how many models there are. The driver and the tasks hold the trees, and no rows.

Boosting fits softmax scores: a round's tree gives every class a step at each leaf, from the sums of first and second
derivatives. Scores are written with the rows every few rounds, so a row is never sent down all trees again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.sources.scratch import remove, scratch_path, settled

#: Bins of a feature at most, and rounds after which scores are written.
BINS, SETTLED = 32, 10
#: No fold is held out.
WHOLE = -1


@dataclass(frozen=True)
class Forest:
    """trees grown apart, each on rows drawn with replacement and some features (the root of their number) at each node."""

    trees: int = 100
    depth: int = 10
    least: float = 2.0
    seed: int = 42
    boosted: bool = False


@dataclass(frozen=True)
class Boosted:
    """trees grown one after another; least rows in a leaf, steps of rate, and shrink added to second derivatives."""

    trees: int = 100
    depth: int = 5
    least: float = 1.0
    seed: int = 42
    rate: float = 0.1
    shrink: float = 1.0
    boosted: bool = True


@dataclass
class Model:
    """One model: its features, each one's bin edges and stand-in for nulls, the classes, the scores to start from, and for each tree its nodes' split features (-1: leaf), bins (left up to it) and values, in heap order (children of i: 2i + 1, 2i + 2); and what the splits by each feature were worth."""

    features: list[str]
    edges: list[list[float]]
    middles: list[float]
    classes: list[int]
    prior: np.ndarray
    boosted: bool
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int16))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int16))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 1, 1)))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shift: list[float] | None = None
    scale: list[float] | None = None

    def binned(self, rows: np.ndarray) -> np.ndarray:
        filled = np.where(np.isfinite(rows), rows, self.middles)
        if self.shift is not None:
            filled = (filled - np.array(self.shift)) * np.array(self.scale)
        return np.stack([np.searchsorted(e, filled[:, k], "left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint16).reshape(len(rows), -1)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        bins = self.binned(rows)
        total = np.tile(self.prior, (len(rows), 1)) if self.boosted else np.zeros((len(rows), len(self.classes)))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            total += v[_leaf(f, c, bins)]
        return _softmax(total) if self.boosted else total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()})

    @classmethod
    def from_json(cls, text: str) -> Model:
        found = json.loads(text)
        kinds = {"prior": np.float64, "feature": np.int16, "cut": np.int16, "value": np.float64, "gain": np.float64}
        return cls(**{k: np.array(v, kinds[k]) if k in kinds else v for k, v in found.items()})


def of_forest(model: PipelineModel, features: Sequence[str]) -> Model:
    """A fitted pipeline of an imputer, a scaler with means and Spark's forest as a Model: its thresholds are the bins' edges, so rows fall as they do there."""
    spark = SparkSession.getActiveSession()
    imputer, _, scaler, forest = model.stages
    path = scratch_path(spark, "forest")
    forest.save(path)
    rows = spark.read.parquet(f"{path}/data").collect()  # a row for each node, as the driver holds them in the model
    nodes = {(r["treeID"], r["nodeData"]["id"]): r["nodeData"] for r in rows}
    remove(spark, path)
    trees, classes = forest.getNumTrees, forest.numClasses
    inner = [n for n in nodes.values() if n["leftChild"] >= 0]
    cut = lambda n: n["split"]["leftCategoriesOrThreshold"][0]
    edges = [sorted({cut(n) for n in inner if n["split"]["featureIndex"] == k}) for k in range(len(features))]
    size = 2 ** (forest.getMaxDepth() + 1) - 1
    out = Model(list(features), edges, [float(x) for x in imputer.surrogateDF.select(*features).first()], list(range(classes)), np.zeros(classes), False)
    out.shift = scaler.mean.toArray().tolist()
    out.scale = [1 / x if x else 0.0 for x in scaler.std.toArray()]
    out.feature, out.cut, out.value = np.full((trees, size), -1, np.int16), np.zeros((trees, size), np.int16), np.zeros((trees, size, classes))
    for t in range(trees):
        todo = [(0, 0)]
        while todo:
            own, place = todo.pop()
            n = nodes[t, own]
            counts = np.array(n["impurityStats"])
            out.value[t, place] = counts / max(counts.sum(), 1e-300)
            if n["leftChild"] >= 0:
                k = n["split"]["featureIndex"]
                out.feature[t, place], out.cut[t, place] = k, edges[k].index(cut(n))
                todo += [(n["leftChild"], 2 * place + 1), (n["rightChild"], 2 * place + 2)]
    return out


def _leaf(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node where each row ends."""
    node, each = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        f = feature[node]
        on = f >= 0
        if not on.any():
            return node
        node = np.where(on, 2 * node + 1 + (bins[each, np.maximum(f, 0)] > cut[node]), node)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers mixed (the splitmix64 finaliser)."""
    z = x + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: How often a row is drawn: places of a uniform number among the Poisson distribution's sums.
_DRAWN = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


def _times(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a forest's tree takes each row."""
    h = _mixed(rows.astype(np.uint64) ^ _mixed(np.array([seed * 1_000_003 + tree], np.uint64)))
    return np.searchsorted(_DRAWN, (h >> np.uint64(11)) / 2.0**53, "right").astype(np.float64)


def _chosen(tree: int, nodes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Which features a forest's tree may split each node by."""
    few = max(1, int(np.sqrt(width)))
    h = _mixed((nodes.astype(np.uint64)[:, None] * np.uint64(64) + np.arange(width, dtype=np.uint64)) ^ _mixed(np.array([seed * 7_919 + tree], np.uint64)))
    return h.argsort(axis=1).argsort(axis=1) < few


def vector(features: Sequence[str]) -> Column:
    """Columns as an array of doubles in their order; null for what is no finite number."""
    cells = [F.col(f).cast("double") for f in features]
    return F.array(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for c in cells])


def prepared(rows: DataFrame, features: Sequence[str], label: str, group: str, fold: str | None = None) -> tuple[DataFrame, dict[int, Model]]:
    """The rows to learn from (row, g, fold, y, bins) and a bare model for each group: bins end midway between neighbouring quantiles of its rows, nulls are in the middle one.

    Rows without a label go; a feature without any value is 0 throughout. The driver holds each group's edges and classes.
    """
    known = rows.where(F.col(label).isNotNull())
    named = known.select(F.col(group).cast("int").alias("g"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), F.col(label).cast("int").alias("y"), vector(features).alias("x"))
    named = settled(named.withColumn("row", F.monotonically_increasing_id()), "samples")
    shares = F.array(*[F.lit(k / BINS) for k in range(BINS + 1)])
    cells = [f for k in range(len(features)) for f in (F.percentile_approx(F.col("x")[k], shares, 10_000).alias(f"e{k}"), F.percentile(F.col("x")[k], 0.5).alias(f"m{k}"))]
    models = {}
    classes: dict[int, dict[int, int]] = {}
    for r in named.groupBy("g", "y").agg(F.count("*").alias("n")).collect():  # a row for each class of a group
        classes.setdefault(r["g"], {})[r["y"]] = r["n"]
    for r in named.groupBy("g").agg(*cells).collect():  # a row for each group
        spots = [sorted(set(r[f"e{k}"] or [])) for k in range(len(features))]
        edges = [[(a + b) / 2 for a, b in zip(v, v[1:])] for v in spots]
        counts = dict(sorted(classes[r["g"]].items()))
        prior = np.log(np.array(list(counts.values()), float) / sum(counts.values()))
        models[r["g"]] = Model(list(features), edges, [r[f"m{k}"] or 0.0 for k in range(len(features))], list(counts), prior, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, y = (batch.column(k).to_numpy() for k in (1, 3))
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            bins, place = np.zeros(x.shape, np.uint8), np.zeros(len(batch), np.int32)
            for one in np.unique(g).tolist():
                here = g == one
                bins[here], place[here] = models[one].binned(x[here]).astype(np.uint8), np.searchsorted(models[one].classes, y[here])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(place), pa.array([b.tobytes() for b in bins], pa.binary())], names=["row", "g", "fold", "y", "bins"])

    return settled(named.select("row", "g", "fold", "y", "x").mapInArrow(run, "row long, g int, fold int, y int, bins binary"), "bins"), models


def grown(data: DataFrame, models: dict[int, Model], held: Sequence[int], how: Forest | Boosted) -> dict[tuple[int, int], Model]:
    """A model for each group and held-out fold (WHOLE: none), of prepared() rows."""
    size, out = 2 ** (how.depth + 1) - 1, {}
    for g, m in models.items():
        for f in held:
            shape = (how.trees, size)
            out[g, f] = replace(m, boosted=how.boosted, feature=np.full(shape, -1, np.int16), cut=np.zeros(shape, np.int16), value=np.zeros((*shape, len(m.classes))), gain=np.zeros(len(m.features)))
    slots = sorted(out)
    state = data.where(F.col("g").isin(list(models))).withColumn("scores", F.lit(None).cast("array<array<double>>"))
    begun = 0
    for turn in range(how.trees if how.boosted else 1):
        trees = range(turn, turn + 1) if how.boosted else range(how.trees)
        if how.boosted and turn - begun == SETTLED:
            state, begun = settled(_scored(state, out, held, begun, turn), "scores"), turn
        open_ = {(s, t): np.array([0]) for s in slots for t in trees}
        for _ in range(how.depth + 1):
            if not open_:
                break
            splits = _level(state, out, held, how, open_, begun, turn)
            open_ = _take(splits, out, how, size)
    return out


def _held_scores(model: Model, scores, k: int, rows: np.ndarray, bins: np.ndarray, begun: int, until: int) -> np.ndarray:
    """Rows' scores before tree until: those written, and the trees since begun."""
    total = np.tile(model.prior, (len(rows), 1)) if scores is None else np.array([scores[i][k] for i in rows], float)
    for t in range(begun, until):
        total += model.value[t][_leaf(model.feature[t], model.cut[t], bins)]
    return total


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Group, its rows in the batch and their bins."""
    g = batch.column("g").to_numpy()
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1), np.uint8)
    for one in np.unique(g).tolist():
        rows = np.flatnonzero(g == one)
        yield one, rows, bins[rows]


def _scored(state: DataFrame, models: dict, held: Sequence[int], begun: int, until: int) -> DataFrame:
    """state with the scores, in each of held's models, after the trees up to until."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("scores").to_pylist()
            old = None if not old or old[0] is None else old
            new: list = [None] * len(batch)
            for g, rows, bins in _parts(batch):
                found = [_held_scores(models[g, f], old, k, rows, bins, begun, until).tolist() for k, f in enumerate(held)]
                for i, *each in zip(rows.tolist(), *found, strict=True):
                    new[i] = each
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, pa.list_(pa.list_(pa.float64())))], names=batch.schema.names)

    return state.mapInArrow(run, state.schema)


def _level(state: DataFrame, models: dict, held: Sequence[int], how: Forest | Boosted, open_: dict, begun: int, turn: int) -> pa.Table:
    """For each open node of each tree (g, held, tree, node): its sums, and its best split's feature (-1: none), bin and left sums."""
    trees = sorted({t for _, t in open_})
    width = 1 + (2 if how.boosted else 1) * max(len(m.classes) for m in models.values())
    names = [f"s{k}" for k in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, y, row = (batch.column(c).to_numpy() for c in ("fold", "y", "row"))
            scores = batch.column("scores").to_pylist() if how.boosted else None
            scores = None if not scores or scores[0] is None else scores
            for g, rows, bins in _parts(batch):
                for k, f in enumerate(held):
                    model = models[g, f]
                    mine = fold[rows] != f
                    if not mine.any():
                        continue
                    some, b, n = rows[mine], bins[mine], len(model.classes)
                    one = np.eye(n)[y[some]]
                    if how.boosted:
                        p = _softmax(_held_scores(model, scores, k, some, b, begun, turn))
                        stats = np.hstack((np.ones((len(some), 1)), p - one, p * (1 - p)))
                    for t in trees:
                        nodes = open_.get(((g, f), t))
                        if nodes is None:
                            continue
                        if not how.boosted:
                            times = _times(row[some], t, how.seed)
                            stats = np.hstack((times[:, None], one * times[:, None]))
                        at = _leaf(model.feature[t], model.cut[t], b)
                        place = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
                        on = (nodes[place] == at) & (stats[:, 0] > 0)
                        if not on.any():
                            continue
                        allowed = np.ones((len(nodes), b.shape[1]), bool) if how.boosted else _chosen(t, nodes, b.shape[1], how.seed)
                        i, c = np.nonzero(allowed[place[on]])
                        key = (place[on][i] * b.shape[1] + c) * (BINS + 1) + b[on][i, c]
                        cells, where = np.unique(key, return_inverse=True)
                        total = np.stack([np.bincount(where, stats[on][i, s], len(cells)) for s in range(stats.shape[1])], axis=1)
                        total = np.pad(total, ((0, 0), (0, width - total.shape[1])))
                        full = lambda v: pa.array(np.full(len(cells), v), pa.int32())  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([full(g), full(f), full(t), pa.array(nodes[cells // (BINS + 1) // b.shape[1]].astype(np.int32)), pa.array((cells // (BINS + 1) % b.shape[1]).astype(np.int32)), pa.array((cells % (BINS + 1)).astype(np.int32)), *(pa.array(x) for x in total.T)], names=["g", "held", "tree", "node", "feature", "bin", *names])

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("node", "ascending"), ("feature", "ascending"), ("bin", "ascending")])
        g, f, t = (rows.column(c)[0].as_py() for c in ("g", "held", "tree"))
        n = len(models[g, f].classes)
        node, feature, bin_ = (rows.column(c).to_numpy() for c in ("node", "feature", "bin"))
        stats = np.stack([rows.column(c).to_numpy() for c in names], axis=1)
        found = []
        for a, b in _runs(node):
            first = feature[a:b] == feature[a]
            whole, gain, split = stats[a:b][first].sum(axis=0), 0.0, None
            for c, d in _runs(feature[a:b]):
                left = np.cumsum(stats[a + c : a + d], axis=0)[:-1]
                if not len(left):
                    continue
                better = _gain(left, whole, n, how)
                i = int(better.argmax())
                if better[i] > gain + 1e-12:
                    gain, split = better[i], (int(feature[a + c]), int(bin_[a + c + i] + bin_[a + c + i + 1] - 1) // 2, left[i])  # in the middle of the bins that no row of the node has
            found.append((int(node[a]), *(split or (-1, 0, whole)), whole, float(gain)))
        columns = [pa.array([x] * len(found), pa.int32()) for x in (g, f, t)] + [pa.array([r[k] for r in found], pa.int32()) for k in range(3)] + [pa.array([r[k].tolist() for r in found], pa.list_(pa.float64())) for k in (3, 4)]
        return pa.Table.from_arrays([*columns, pa.array([r[5] for r in found])], names=["g", "held", "tree", "node", "feature", "bin", "left", "whole", "gain"])

    keys = "g int, held int, tree int, node int, feature int, bin int"
    found = state.mapInArrow(sums, f"{keys}, " + ", ".join(f"{n} double" for n in names))
    found = found.groupBy("g", "held", "tree", "node", "feature", "bin").agg(*[F.sum(n).alias(n) for n in names])
    return found.groupBy("g", "held", "tree").applyInArrow(best, f"{keys}, left array<double>, whole array<double>, gain double").toArrow()  # a row for each open node


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    at = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return zip(at, at[1:])


def _gain(left: np.ndarray, whole: np.ndarray, n: int, how: Forest | Boosted) -> np.ndarray:
    """What each split is worth: less of a node's squared derivatives over their curvature, or less impurity; none where a side has too few rows."""
    right = whole - left
    if how.boosted:
        worth = lambda s: (s[..., 1 : n + 1] ** 2 / (s[..., n + 1 : 2 * n + 1] + how.shrink)).sum(axis=-1)
    else:
        worth = lambda s: (s[..., 1 : n + 1] ** 2).sum(axis=-1) / np.maximum(s[..., 0], 1e-300)
    enough = (left[:, 0] >= how.least) & (right[:, 0] >= how.least)
    return np.where(enough, worth(left) + worth(right) - worth(whole), -1.0)


def _take(splits: pa.Table, models: dict, how: Forest | Boosted, size: int) -> dict:
    """Writes splits and values into the models; the nodes that are open now."""
    open_: dict = {}
    for r in splits.to_pylist():
        model, t, node = models[r["g"], r["held"]], r["tree"], r["node"]
        n = len(model.classes)
        whole, left = np.array(r["whole"]), np.array(r["left"])
        value = lambda s: -how.rate * s[1 : n + 1] / (s[n + 1 : 2 * n + 1] + how.shrink) if how.boosted else s[1 : n + 1] / max(s[0], 1e-300)  # noqa: B023, E731
        model.value[t, node] = value(whole)
        if r["feature"] >= 0 and 2 * node + 2 < size:
            model.feature[t, node], model.cut[t, node] = r["feature"], r["bin"]
            model.gain[r["feature"]] += r["gain"]
            for child, s in ((2 * node + 1, left), (2 * node + 2, whole - left)):
                model.value[t, child] = value(s)
                if 2 * child + 2 < size:
                    open_.setdefault(((r["g"], r["held"]), t), []).append(child)
    return {k: np.array(sorted(v)) for k, v in open_.items()}


def scored(rows: DataFrame, models: dict[int, Model], group: str | None = None) -> DataFrame:
    """rows with probabilities, a map of each class of their group's model (the only one, without group) to its probability; null where there is no model."""
    features = next(iter(models.values())).features
    named = rows.withColumns({"_g": F.col(group).cast("int") if group else F.lit(next(iter(models))), "_x": vector(features)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(batch.schema.get_field_index("_g")).to_numpy(zero_copy_only=False)
            x = batch.column(batch.schema.get_field_index("_x")).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            out: list = [None] * len(batch)
            for one in {int(v) for v in g if v == v}:
                if one in models:
                    here = np.flatnonzero(g == one)
                    for i, p in zip(here.tolist(), models[one].probabilities(x[here]).tolist(), strict=True):
                        out[i] = list(zip(models[one].classes, p))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.map_(pa.int32(), pa.float64()))], names=[*batch.schema.names, "probabilities"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema)
    return named.mapInArrow(run, f"{schema}, probabilities map<int,double>").drop("_g", "_x")


def held_out(data: DataFrame, models: dict[tuple[int, int], Model], held: Sequence[int]) -> DataFrame:
    """g, fold, n, hits and loss (the sum of logarithmic losses) of each model on the fold that it was not grown on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, y = (batch.column(c).to_numpy() for c in ("fold", "y"))
            for g, rows, bins in _parts(batch):
                for f in held:
                    mine = fold[rows] == f
                    if mine.any():
                        m = models[g, f]
                        total = np.tile(m.prior, (int(mine.sum()), 1)) if m.boosted else np.zeros((int(mine.sum()), len(m.classes)))
                        for a, c, v in zip(m.feature, m.cut, m.value, strict=True):
                            total += v[_leaf(a, c, bins[mine])]
                        p = _softmax(total) if m.boosted else total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
                        truth = y[rows][mine]
                        losses = -np.log(np.maximum(p[np.arange(len(p)), truth], 1e-15))
                        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([f], pa.int32()), pa.array([len(p)], pa.int64()), pa.array([int((p.argmax(axis=1) == truth).sum())], pa.int64()), pa.array([float(losses.sum())])], names=["g", "fold", "n", "hits", "loss"])

    each = data.select("g", "fold", "y", "bins").mapInArrow(run, "g int, fold int, n long, hits long, loss double")
    return each.groupBy("g", "fold").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "loss")])
