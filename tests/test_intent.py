"""Features against a plain numpy restatement, models by what they must learn."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.operators import decisions, intent, trees
from strideline.plans.params import Decision, Junction
from strideline.sources.points import FIELDS

AT = [Junction(0, 0, 0, 10, 30)]


@pytest.fixture(scope="module")
def walks():
    """Straight approaches from the left that turn up (branch 1) where they come high, else down (branch 0)."""
    rng, out = np.random.default_rng(1), {}
    for k in range(60):
        up = k % 2
        x = np.concatenate((np.linspace(-120, 0, 61), np.linspace(0.5, 15, 30)))
        z = np.concatenate((np.full(61, 4.0 if up else -4.0), (1 if up else -1) * np.linspace(5, 60, 30)))
        out[f"w{k:02d}"] = (np.column_stack((x, z + rng.normal(0, 0.3, len(z)))), up)
    return out


@pytest.fixture(scope="module")
def rows(spark, walks):
    cells = [(t, i, float(x), float(z), 0.5 * i, math.sin(0.1 * i), math.cos(0.1 * i), 0.3, 0.4, 60.0 + i % 7, 3.0 + 0.01 * i) for t, (w, _) in walks.items() for i, (x, z) in enumerate(w)]
    df = spark.createDataFrame(cells, "trajectory string, idx int, x double, z double, t double, head_forward_x double, head_forward_z double, gaze_x double, gaze_y double, heart_rate double, pupil_l double")
    df = df.withColumns({c: F.lit(None).cast("double") for c in FIELDS if c not in df.columns})
    return decisions.frame(df, AT, Decision(mode="radial")).persist()


@pytest.fixture(scope="module")
def labels(spark, walks):
    return spark.createDataFrame([(t, 0, up) for t, (_, up) in walks.items()], "trajectory string, junction int, branch int")


def expected(w, before):
    dist = np.hypot(w[:, 0], w[:, 1])
    entry = int(np.argmax(dist <= 10))
    a = int(np.argmin(np.abs(dist[:entry] - (10 + before))))
    part = w[a - 10 : a + 1]
    step = np.diff(part, axis=0)
    seg, v = np.hypot(*step.T), np.hypot(*step.T) / 0.5
    course = np.arctan2(step[:, 1], step[:, 0])
    bend = np.abs(np.angle(np.exp(1j * np.diff(course))))
    to, went = -part[-1], part[-1] - part[0]
    chord = np.hypot(*went)
    turn = np.angle(np.exp(1j * (np.arctan2(went[1], went[0]) - np.arctan2(to[1], to[0]))))
    gaze = math.atan2(0.4, 0.3)
    return {
        "distance": dist[a], "approach_angle": abs(turn), "lateral_offset": abs(went[0] * to[1] - went[1] * to[0]) / (chord + 1e-6), "speed": v[-3:].mean(),
        "acceleration": np.diff(v)[-4:].mean(), "curvature": bend.mean(), "sinuosity": seg.sum() / (chord + 1e-6), "time_to_junction": dist[a] / v[-3:].mean(),
        "gaze_angle": gaze, "gaze_alignment": math.cos(gaze - math.atan2(to[1], to[0])), "head_variability": 0.0, "heart_rate": 60.0 + a % 7,
        "heart_rate_trend": (a % 7) - ((a - 10) % 7), "pupil": 3 + 0.01 * a, "pupil_trend": 0.1, "previous_choice": -1.0,
    }


@pytest.mark.parametrize("before", [25.0, 50.0])
def test_features(rows, walks, before):
    found = {r["trajectory"]: r.asDict() for r in intent.features(rows, before).collect()}
    assert set(found) == set(walks)
    for t, (w, _) in walks.items():
        for name, value in expected(w, before).items():
            assert found[t][name] == pytest.approx(value, abs=1e-6), (t, name)


def test_forest_learns_the_turn(rows, labels, walks):
    known = intent.labelled(intent.features(rows, 50.0), labels)
    model = intent.train(known)
    got = {r["trajectory"]: r for r in intent.predict(model, known).collect()}
    assert np.mean([got[t]["predicted"] == up for t, (_, up) in walks.items()]) > 0.95
    assert all(r["confidence"] == pytest.approx(max(r["probabilities"].values())) and set(r["probabilities"]) == {0, 1} for r in got.values())
    assert sum(intent.importances(model).values()) == pytest.approx(1.0)
    assert intent.train(known.limit(9)) is None


def test_analysis_and_samples(spark, rows, labels, tmp_path):
    found = intent.analyze(rows, labels, distances=(50.0,), folds_of=3)
    row = found.first()
    assert (row["junction"], row["distance"], row["samples"]) == (0, 50.0, 60) and row["accuracy"] > 90 and row["band"] == "high"
    assert intent.junction_summary(found).first()["samples"] == 60
    models = intent.train_by_distance(rows, labels, (50.0,))
    seen = intent.sample_predictions(models, rows, labels, 4).collect()
    assert sorted(r["trajectory"] for r in seen) == ["w00", "w01", "w02", "w03"] and all(r["correct"] == (r["predicted"] == r["actual"]) for r in seen)
    intent.save_models(models, f"file://{tmp_path}/models")
    again = intent.load_model(f"file://{tmp_path}/models", 50.0)
    known = intent.features(rows, 50.0)
    pick = lambda m: sorted((r["trajectory"], r["predicted"]) for r in intent.predict(m, known).collect())
    assert pick(again) == pick(models[50.0])
    with pytest.raises(Exception, match="50|path|Path|exist"):
        intent.load_model(f"file://{tmp_path}/models", 33.0)
    bands = spark.createDataFrame([(0.9,), (0.8,), (0.7,)], "a double").select(intent.band(F.col("a")))
    assert [r[0] for r in bands.collect()] == ["high", "medium", "low"]


@pytest.fixture(scope="module")
def three(spark):
    """Rows of two junctions, one with three branches that two features tell apart (one noisily), one with two; features with nulls and one without any value."""
    rng, out = np.random.default_rng(7), []
    for j, kinds in ((0, 3), (4, 2)):
        for k in range(120):
            b = int(rng.integers(0, kinds))
            cells = rng.normal(0, 1, len(intent.FEATURES))
            cells[0], cells[3] = b + rng.normal(0, 0.45), (b == 1) * 2 + rng.normal(0, 0.8)
            values = [None if rng.random() < 0.05 else float(x) for x in cells]
            values[5] = None
            out.append((f"t{k}", j, *values, float(b)))
    return spark.createDataFrame(out, "trajectory string, junction int, " + ", ".join(f"{f} double" for f in intent.FEATURES) + ", branch double").repartition(3).persist()


SMALL = trees.Boosted(trees=12, depth=3, rate=0.3)


def test_boosted_probabilities(three, tmp_path):
    known = three.where("junction = 0")
    model = intent.train(known, SMALL)
    found = intent.predict(model, known).collect()
    assert len(found) == 120 and all(set(r["probabilities"]) == {0, 1, 2} and sum(r["probabilities"].values()) == pytest.approx(1.0) for r in found)
    assert all(r["confidence"] == max(r["probabilities"].values()) == r["probabilities"][r["predicted"]] for r in found)
    truth = {r["trajectory"]: int(r["branch"]) for r in known.collect()}
    loss = lambda rows: -np.mean([math.log(r["probabilities"][truth[r["trajectory"]]]) for r in rows])
    losses = [loss(intent.predict(intent.train(known, replace(SMALL, trees=n)), known).collect()) for n in (1, 4)] + [loss(found)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.5 * math.log(3)
    shares = intent.importances(model)
    assert sum(shares.values()) == pytest.approx(1.0) and shares["distance"] + shares["speed"] > 0.6
    intent.save_models({50.0: model}, f"file://{tmp_path}/m")
    again = intent.predict(intent.load_model(f"file://{tmp_path}/m", 50.0), known).collect()
    assert sorted(again) == sorted(found)
    assert intent.train(known.limit(9), SMALL) is None
    with pytest.raises(ValueError):
        intent.train(known, "other")


def plain_boosting(bins, y, classes, how):
    """The same boosting in numpy, tree by tree and node by node."""
    n, scores = len(y), np.tile(np.log(np.bincount(y, minlength=classes) / len(y)), (len(y), 1))
    one = np.eye(classes)[y]
    for _ in range(how.trees):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        g, h = p - one, p * (1 - p)
        todo = [(np.arange(n), 0)]
        while todo:
            rows, depth = todo.pop()
            worth = lambda r: (g[r].sum(axis=0) ** 2 / (h[r].sum(axis=0) + how.shrink)).sum()  # noqa: B023, E731
            best = (1e-12, None)
            for f in range(bins.shape[1]) if depth < how.depth else ():
                for b in np.unique(bins[rows, f])[:-1]:
                    left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
            if best[1]:
                todo += [(r, depth + 1) for r in best[1]]
            else:
                scores[rows] -= how.rate * g[rows].sum(axis=0) / (h[rows].sum(axis=0) + how.shrink)
    return np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)


def test_boosting_equals_numpy(three, monkeypatch):
    monkeypatch.setattr(trees, "SETTLED", 2)  # scores are written in between
    how = trees.Boosted(trees=5, depth=3, rate=0.4)
    for j, classes in ((0, 3), (4, 2)):
        known = three.where(f"junction = {j}")
        model = intent.train(known, how)
        frame = known.toPandas()
        x = frame[list(intent.FEATURES)].to_numpy(float)
        want = plain_boosting(model.binned(x).astype(int), frame["branch"].to_numpy().astype(int), classes, how)
        assert np.abs(model.probabilities(x) - want).max() < 1e-9


@pytest.mark.parametrize("how", [SMALL, trees.Forest(trees=15, depth=5)])
def test_grown_together_as_apart(spark, three, how):
    """Models of all groups and folds at once equal those grown one by one, in as many jobs as one."""
    dealt = intent.folds(three.withColumn("_g", F.col("junction")), 3, "_g").persist()
    sizes = dealt.groupBy("_g", "branch", "fold").count().toPandas().groupby(["_g", "branch"])["count"]
    assert (sizes.max() - sizes.min()).max() <= 1
    tracker = spark.sparkContext.statusTracker()

    def jobs(group, run):
        spark.sparkContext.setJobGroup(group, group)
        out = run()
        n = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("other", "other")
        return out, n

    data, bare = trees.prepared(dealt, intent.FEATURES, "branch", "_g", "fold")
    together, many = jobs(f"all-{how.boosted}", lambda: trees.grown(data, bare, range(3), how))
    few = None
    for g in (0, 4):
        for f in range(3):
            alone, few = jobs(f"{g}-{f}-{how.boosted}", lambda: trees.grown(data, {g: bare[g]}, [f], how))  # noqa: B023
            for name in ("feature", "cut", "value"):
                assert np.allclose(getattr(alone[g, f], name), getattr(together[g, f], name))
    assert many <= few + 2 * (how.depth + 1)
    scores = {(r["g"], r["fold"]): r for r in trees.held_out(data, together, range(3)).collect()}
    frame = dealt.toPandas()
    for (g, f), m in together.items():
        mine = frame[(frame["_g"] == g) & (frame["fold"] == f)]
        p = m.probabilities(mine[list(intent.FEATURES)].to_numpy(float))
        y = mine["branch"].to_numpy().astype(int)
        assert scores[g, f]["hits"] == (p.argmax(axis=1) == y).sum() and scores[g, f]["n"] == len(y)
        assert scores[g, f]["loss"] == pytest.approx(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)).sum())
        assert (p.argmax(axis=1) == y).mean() > (0.6 if g == 0 else 0.7)
    dealt.unpersist()


def test_boosting_beats_the_forest_on_planted_walks(rows, labels):
    both = {name: intent.analyze(rows, labels, distances=(50.0, 25.0), folds_of=3, model=how).collect() for name, how in (("forest", trees.Forest(trees=20, depth=4)), ("boosted", trees.Boosted(trees=20, depth=2, rate=0.3)))}
    for a, b in zip(*(sorted(both[k], key=lambda r: r["distance"]) for k in ("forest", "boosted"))):
        assert (a["junction"], a["distance"]) == (b["junction"], b["distance"]) and b["loss"] <= a["loss"] + 1e-9
        assert b["accuracy"] > 90 and b["samples"] == 60 and b["deviation"] >= 0
    assert len(intent.cross_validate(intent.labelled(intent.features(rows, 50.0), labels), SMALL, 4)) == 4


def test_saved_forests_in_one_pass(spark, three, tmp_path):
    """Forests of several distances, flattened, give every row what their pipelines give it."""
    spread = three.drop("junction").withColumn("junction", F.lit(0))
    models = {d: intent.pipeline(seed).fit(intent._filled(three.where(f"junction = {j}"))) for d, j, seed in ((100.0, 0, 1), (25.0, 4, 2))}
    intent.save_models(models, f"file://{tmp_path}/models")
    models = {d: intent.load_model(f"file://{tmp_path}/models", d) for d in models}
    every = spread.withColumn("distance_before", F.explode(F.array(F.lit(100.0), F.lit(25.0)))).withColumn("key", F.xxhash64(*intent.FEATURES))
    found = {(r["key"], r["distance_before"]): r["probabilities"] for r in intent.walked(every, models).withColumn("key", F.col("key")).collect()}
    for d, m in models.items():
        for r in m.transform(spread.withColumn("key", F.xxhash64(*intent.FEATURES)).fillna(0.0, list(intent.FEATURES))).select("key", "probability", "prediction").collect():
            mine = found[r["key"], d]
            assert [mine[k] for k in sorted(mine)] == pytest.approx(r["probability"].toArray().tolist(), abs=1e-12)
            assert max(mine, key=lambda k: (mine[k], -k)) == int(r["prediction"])


def test_vectors_in_the_order_of_the_features(spark):
    values = [float(k) for k in range(len(intent.FEATURES))]
    rows_ = [("a", *values), ("b", float("nan"), float("inf"), None, *values[3:-1], None)]
    df = spark.createDataFrame(rows_, "trajectory string, " + ", ".join(f"{f} double" for f in intent.FEATURES))
    found = {r["trajectory"]: r["vector"] for r in intent.vectors(df).collect()}
    assert found == {"a": values, "b": [None, None, None, *values[3:-1], -1.0]}
