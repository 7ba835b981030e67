"""Early intent: features of the approach at a distance before a junction, and models that predict the branch from them.

Forests for use are Spark's own. Boosted trees, and the many models that tell how well each junction's branch is foreseen
from each distance, are grown by trees.grown(), all junctions, distances and folds in the same jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideline.functions.geometry import length, turn
from strideline.operators.decisions import KEYS
from strideline.operators import trees
from strideline.operators.gaze import _mean_pupil
from strideline.operators.ranks import ranked
from strideline.sources.scratch import settled

FEATURES = ("distance", "approach_angle", "lateral_offset", "speed", "acceleration", "curvature", "sinuosity", "time_to_junction", "gaze_angle", "gaze_alignment", "head_variability", "heart_rate", "heart_rate_trend", "pupil", "pupil_trend", "previous_choice")
#: Distances before the junction's edge at which models are trained by default.
DISTANCES = (100.0, 75.0, 50.0, 25.0)
WINDOW, LEAST = 10, 10


def anchors(rows: DataFrame, before: float) -> DataFrame:
    """trajectory, junction, anchor: the point before entry nearest to r + before from the centre, for trajectories that enter after 10 points or more and have 5 before it."""
    g = rows.where(F.col("entered") & (F.col("first_in") >= LEAST) & (F.col("idx") < F.col("first_in"))).groupBy(*KEYS).agg(F.min(F.struct(F.abs(F.col("dist") - (F.col("r") + before)).alias("off"), "idx"))["idx"].alias("anchor"))
    return g.where("anchor >= 5")


def features(rows: DataFrame, before: float, previous: DataFrame | None = None) -> DataFrame:
    """trajectory, junction and FEATURES at the anchor, from the ten steps up to it; previous gives previous_choice."""
    at = anchors(rows, before)
    w = Window.partitionBy(*KEYS).orderBy("idx")
    near = rows.join(at, list(KEYS)).where((F.col("idx") <= F.col("anchor")) & (F.col("idx") >= F.col("anchor") - WINDOW))
    moved = F.col("_k") > 0
    dt = F.col("t") - F.lag("t").over(w)
    near = near.withColumns({"_k": F.row_number().over(w) - 1, "dt": dt, "head": F.atan2("head_forward_x", "head_forward_z"), "pupil": _mean_pupil()})
    near = near.withColumns({"v": F.when(moved, F.col("seg") / F.when(F.col("dt") > 0, F.col("dt")).otherwise(1.0)), "heading": F.when(moved, F.atan2("dz", "dx")), "left": F.col("anchor") - F.col("idx")})
    near = near.withColumns({"dv": F.when((F.col("_k") > 1) & (F.col("left") < 4), F.col("v") - F.lag("v").over(w)), "bend": F.when(F.col("_k") > 1, F.abs(turn(F.col("heading"), F.lag("heading").over(w)))), "swing": F.col("head") - F.lag("head").over(w)})
    here = F.col("idx") == F.col("anchor")
    pick = lambda c: F.max(F.when(here, F.col(c) if isinstance(c, str) else c))
    edge = lambda c, f: f(F.when(F.col(c).isNotNull(), F.struct("idx", c)))[c]
    g = near.groupBy(*KEYS).agg(
        pick("dist").alias("distance"), pick("cx").alias("cx"), pick("cz").alias("cz"), pick("x").alias("x1"), pick("z").alias("z1"),
        F.min(F.struct("idx", "x", "z")).alias("begin"), F.sum(F.when(moved, F.col("seg"))).alias("path"), F.max("_k").alias("steps"),
        F.avg(F.when(F.col("left") < 3, F.col("v"))).alias("speed"), F.avg("dv").alias("dv"), F.avg("bend").alias("bend"),
        pick(F.atan2("gaze_y", "gaze_x")).alias("gaze_angle"), F.stddev_pop("swing").alias("head_variability"),
        pick("heart_rate").alias("heart_rate"), (edge("heart_rate", F.max) - edge("heart_rate", F.min)).alias("heart_rate_trend"),
        pick("pupil").alias("pupil"), (edge("pupil", F.max) - edge("pupil", F.min)).alias("pupil_trend"),
    )
    mx, mz = F.col("x1") - F.col("begin.x"), F.col("z1") - F.col("begin.z")
    jx, jz = F.col("cx") - F.col("x1"), F.col("cz") - F.col("z1")
    chord = length(mx, mz)
    named = g.select(
        *KEYS, "distance",
        F.abs(turn(F.atan2(mz, mx), F.atan2(jz, jx))).alias("approach_angle"),
        (F.abs(mx * jz - mz * jx) / (chord + 1e-6)).alias("lateral_offset"),
        "speed", F.when(F.col("steps") >= 5, F.col("dv")).otherwise(0.0).alias("acceleration"),
        F.when(F.col("steps") >= 3, F.col("bend")).otherwise(0.0).alias("curvature"),
        (F.col("path") / (chord + 1e-6)).alias("sinuosity"),
        (F.col("distance") / F.when(F.col("speed") > 0, F.col("speed"))).alias("time_to_junction"),
        "gaze_angle", F.cos(turn(F.col("gaze_angle"), F.atan2(jz, jx))).alias("gaze_alignment"),
        "head_variability", "heart_rate", "heart_rate_trend", "pupil", "pupil_trend",
    )
    if previous is None:
        return named.withColumn("previous_choice", F.lit(-1.0))
    return named.join(previous.select(*KEYS, F.col("branch").cast("double").alias("previous_choice")), list(KEYS), "left").fillna(-1.0, ["previous_choice"])


def vectors(found: DataFrame) -> DataFrame:
    """found with vector, the FEATURES in their order: null for nulls, NaN and infinities, -1 for an unknown previous choice."""
    return found.withColumn("vector", trees.vector(FEATURES)).withColumn("vector", F.concat(F.slice("vector", 1, len(FEATURES) - 1), F.array(F.coalesce("previous_choice", F.lit(-1.0)))))


def _filled(rows: DataFrame) -> DataFrame:
    """Columns without any value get 0, as no median can be taken."""
    counts = rows.agg(*[F.count(c).alias(c) for c in FEATURES]).first()
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in FEATURES if not counts[c]})


def pipeline(seed: int = 42) -> Pipeline:
    """Median imputation, scaling to mean 0 and deviation 1, and a forest of 100 trees of depth 10."""
    names = [f"{c}_i" for c in FEATURES]
    forest = RandomForestClassifier(numTrees=100, maxDepth=10, minInstancesPerNode=2, seed=seed, labelCol="branch", featuresCol="scaled")
    return Pipeline(stages=[Imputer(strategy="median", inputCols=list(FEATURES), outputCols=names), VectorAssembler(inputCols=names, outputCol="vector"), StandardScaler(inputCol="vector", outputCol="scaled", withMean=True), forest])


#: What a model's name stands for where many are grown at once.
KINDS = {"random_forest": trees.Forest(), "gradient_boosting": trees.Boosted()}


def labelled(found: DataFrame, assignments: DataFrame) -> DataFrame:
    return found.join(assignments.where("branch >= 0").select(*KEYS, F.col("branch").cast("double").alias("branch")), list(KEYS))


def train(rows: DataFrame, model: str | trees.Boosted = "random_forest") -> PipelineModel | trees.Model | None:
    """A model from labelled features, or None from fewer than ten rows: Spark's forest, or boosted trees (100 of depth 5 and rate 0.1, or as given)."""
    if model == "random_forest":
        return pipeline().fit(_filled(rows)) if rows.count() >= LEAST else None
    found = _grown(rows.withColumn("_g", F.lit(0)), _kind(model), (trees.WHOLE,))[1]
    return found.get((0, trees.WHOLE))


def _kind(model: str | trees.Forest | trees.Boosted) -> trees.Forest | trees.Boosted:
    if isinstance(model, str) and model not in KINDS:
        raise ValueError("model must be random_forest or gradient_boosting")
    return KINDS[model] if isinstance(model, str) else model


def _grown(rows: DataFrame, how: trees.Forest | trees.Boosted, held: Sequence[int], fold: str | None = None) -> tuple[DataFrame, dict]:
    """The prepared rows, and a model for each group (_g) of ten rows or more and each held-out fold."""
    data, bare = trees.prepared(rows, FEATURES, "branch", "_g", fold)
    sizes = {r["g"]: r["n"] for r in data.groupBy("g").agg(F.count("*").alias("n")).collect()}  # a row for each group
    bare = {g: m for g, m in bare.items() if sizes[g] >= LEAST}
    some = data.where(F.col("g").isin(list(bare)))
    return some, trees.grown(some, bare, held, how) if bare else {}


def folds(rows: DataFrame, k: int = 5, *by: str) -> DataFrame:
    """rows with fold: the members of each branch (of each group of by) dealt out in turn, in the order of a hash of their ids."""
    placed = ranked(rows.withColumn("_h", F.xxhash64("trajectory")), *by, "branch", "_h", "trajectory", as_="_place")
    first = placed.groupBy(*by, "branch").agg(F.min("_place").alias("_first"))
    return placed.join(first, [*by, "branch"]).withColumn("fold", ((F.col("_place") - F.col("_first")) % k).cast("int")).drop("_h", "_place", "_first")


def cross_validate(rows: DataFrame, model: str | trees.Forest | trees.Boosted = "random_forest", k: int = 5) -> list[float]:
    """Accuracy on each of k stratified folds; the k models are grown together."""
    data, found = _grown(folds(rows.withColumn("_g", F.lit(0)), k), _kind(model), range(k), "fold")
    return [r["hits"] / r["n"] for r in trees.held_out(data, found, range(k)).orderBy("fold").collect()] if found else []


def importances(model: PipelineModel | trees.Model) -> dict[str, float]:
    """Each feature's share in a model's decisions."""
    if isinstance(model, trees.Model):
        return dict(zip(FEATURES, map(float, model.gain / max(model.gain.sum(), 1e-300)), strict=True))
    return dict(zip(FEATURES, map(float, model.stages[-1].featureImportances), strict=True))


def predict(model: PipelineModel | trees.Model, rows: DataFrame) -> DataFrame:
    """trajectory, junction, predicted, confidence (the greatest probability) and probabilities (branch to probability)."""
    if isinstance(model, trees.Model):
        return _named(trees.scored(rows, {0: model}))
    out = model.transform(rows.fillna(0.0, list(FEATURES))).withColumn("_p", vector_to_array("probability"))
    return _named(out.withColumn("probabilities", F.map_from_arrays(F.sequence(F.lit(0), F.size("_p") - 1), "_p")))


def _named(out: DataFrame, *more: str) -> DataFrame:
    """Of equal probabilities the lower branch is predicted."""
    best = F.array_max(F.transform(F.map_entries("probabilities"), lambda e: F.struct(e["value"].alias("p"), (-e["key"]).alias("turn"))))
    return out.select(*KEYS, *more, (-best["turn"]).cast("int").alias("predicted"), best["p"].alias("confidence"), "probabilities")


def _all_distances(rows: DataFrame, assignments: DataFrame | None, distances: Sequence[float]) -> DataFrame:
    """features() at each distance (with assignments, labelled), and distance."""
    out = None
    for d in distances:
        found = features(rows, d)
        one = (found if assignments is None else labelled(found, assignments)).withColumn("distance_before", F.lit(float(d)))
        out = one if out is None else out.unionByName(one)
    return out


def train_by_distance(rows: DataFrame, assignments: DataFrame, distances: Sequence[float] = DISTANCES, model: str | trees.Boosted = "random_forest") -> dict[float, PipelineModel | trees.Model]:
    """A model for each distance with enough rows; boosted trees of all distances are grown together."""
    if model == "random_forest":
        found = {d: train(labelled(features(rows, d), assignments)) for d in distances}
        return {d: m for d, m in found.items() if m is not None}
    known = settled(_all_distances(rows, assignments, distances), "features")
    place = F.element_at(F.create_map(*[x for k, d in enumerate(distances) for x in (F.lit(float(d)), F.lit(k))]), F.col("distance_before"))
    grown = _grown(known.withColumn("_g", place), _kind(model), (trees.WHOLE,))[1]
    return {distances[g]: m for (g, _), m in sorted(grown.items())}


def analyze(rows: DataFrame, assignments: DataFrame, *, distances: Sequence[float] = DISTANCES, model: str | trees.Forest | trees.Boosted = "random_forest", folds_of: int = 5) -> DataFrame:
    """junction, distance, accuracy and deviation (of the folds, in percent), samples, loss (the mean logarithmic loss of held-out rows), band: how well each junction's branch is foreseen from each distance, where ten rows or more have a branch.

    The models of all junctions, distances and folds are grown together: the number of Spark jobs is that of one model.
    """
    known = settled(_all_distances(rows, assignments, distances), "features")
    pairs = [tuple(r) for r in known.select("junction", "distance_before").distinct().orderBy("junction", "distance_before").collect()]  # junctions times distances
    groups = rows.sparkSession.createDataFrame([(j, d, k) for k, (j, d) in enumerate(pairs)], "junction int, distance_before double, _g int")
    dealt = folds(known.join(F.broadcast(groups), ["junction", "distance_before"]), folds_of, "_g")
    data, found = _grown(dealt, _kind(model), range(folds_of), "fold")
    if not found:
        return rows.sparkSession.createDataFrame([], "junction int, distance double, accuracy double, deviation double, samples long, loss double, band string")
    each = trees.held_out(data, found, range(folds_of)).withColumn("a", 100 * F.col("hits") / F.col("n"))
    g = each.groupBy("g").agg(F.avg("a").alias("accuracy"), F.stddev_pop("a").alias("deviation"), F.sum("n").alias("samples"), (F.sum("loss") / F.sum("n")).alias("loss"))
    out = g.join(F.broadcast(groups), F.col("g") == F.col("_g"))
    return out.select("junction", F.col("distance_before").alias("distance"), "accuracy", "deviation", "samples", "loss", band(F.col("accuracy") / 100).alias("band"))


def junction_summary(found: DataFrame) -> DataFrame:
    """junction, accuracy (the mean over distances), samples (those of the greatest distance) of analyze()."""
    return found.groupBy("junction").agg(F.avg("accuracy").alias("accuracy"), F.max_by("samples", "distance").alias("samples"))


def predict_by_distance(models: dict[float, PipelineModel | trees.Model], rows: DataFrame) -> DataFrame:
    """predict() at every distance that has a model, with distance, in one pass over the features: all models are tables that rows are held against."""
    every = _all_distances(rows, None, list(models))
    return _named(walked(every, models), F.col("distance_before").alias("distance"))


def walked(rows: DataFrame, models: dict[float, PipelineModel | trees.Model]) -> DataFrame:
    """rows (features and distance_before) with probabilities by their distance's model."""
    if any(isinstance(m, PipelineModel) for m in models.values()):
        rows = rows.fillna(0.0, list(FEATURES))  # as predict() does
    plain = {k: trees.of_forest(m, FEATURES) if isinstance(m, PipelineModel) else m for k, m in enumerate(models.values())}
    place = F.element_at(F.create_map(*[x for k, d in enumerate(models) for x in (F.lit(float(d)), F.lit(k))]), F.col("distance_before"))
    return trees.scored(rows.withColumn("_model", place), plain, "_model").drop("_model")


def sample_predictions(models: dict[float, PipelineModel | trees.Model], rows: DataFrame, assignments: DataFrame, most: int = 10) -> DataFrame:
    """trajectory, junction, actual, distance, predicted, confidence, correct for the first trajectories, by id, that have a branch."""
    actual = assignments.where("branch >= 0").select(*KEYS, F.col("branch").alias("actual"))
    some = actual.join(actual.select("trajectory").distinct().orderBy("trajectory").limit(most), "trajectory", "left_semi")
    found = predict_by_distance(models, rows).join(some, list(KEYS))
    return found.select(*KEYS, "actual", "distance", "predicted", "confidence", (F.col("predicted") == F.col("actual")).alias("correct"))


def save_models(models: dict[float, PipelineModel | trees.Model], path: str) -> None:
    """Each model under distance=<distance>: Spark's forests as Spark writes them, boosted trees as one row of JSON."""
    spark = SparkSession.getActiveSession()
    for d, m in models.items():
        if isinstance(m, trees.Model):
            spark.createDataFrame([(m.to_json(),)], "model string").write.mode("overwrite").parquet(f"{path}/distance={d:g}/boosted")
        else:
            m.write().overwrite().save(f"{path}/distance={d:g}/forest")


def load_model(path: str, distance: float) -> PipelineModel | trees.Model:
    """A saved model; an unknown distance raises."""
    spark = SparkSession.getActiveSession()
    at = f"{path}/distance={distance:g}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/boosted")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return trees.Model.from_json(spark.read.parquet(f"{at}/boosted").first()["model"])
    return PipelineModel.load(f"{at}/forest")


def band(accuracy: Column) -> Column:
    return F.when(accuracy > 0.85, "high").when(accuracy > 0.70, "medium").otherwise("low")
