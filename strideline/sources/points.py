"""Sources and sinks of trajectories as a long table of points: trajectory, idx, x, z, t and optional signals."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideline.functions.geometry import length, number
from strideline.plans.params import Junction, from_pairs, junctions
from strideline.sources.files import empty_files, parsed

SIGNALS = ("head_forward_x", "head_forward_y", "head_forward_z", "head_up_x", "head_up_y", "head_up_z", "gaze_x", "gaze_y", "heart_rate", "pupil_l", "pupil_r")
FIELDS = ("x", "z", "t", *SIGNALS)


@dataclass(frozen=True)
class ColumnMapping:
    """Physical column of each logical field. The defaults are fixed values: the recorder's column names."""

    x: str = "x"
    z: str = "z"
    t: str = "t"
    head_forward_x: str = "Headset.Head.Forward.X"
    head_forward_y: str = "Headset.Head.Forward.Y"
    head_forward_z: str = "Headset.Head.Forward.Z"
    head_up_x: str = "Headset.Head.Up.X"
    head_up_y: str = "Headset.Head.Up.Y"
    head_up_z: str = "Headset.Head.Up.Z"
    gaze_x: str = "Headset.Gaze.X"
    gaze_y: str = "Headset.Gaze.Y"
    heart_rate: str = "Headset.HeartRate"
    pupil_l: str = "Headset.PupilDilation.L"
    pupil_r: str = "Headset.PupilDilation.R"

    @classmethod
    def parse(cls, values: str | dict) -> ColumnMapping:
        return from_pairs(cls, values)


# Parts of a column's name that tell its signal. A side or axis counts outside the signal's own word, and
# "hr" as a word of its own.
_SIGNS = {
    "pupil_l": (("pupil",), ("l", "left")), "pupil_r": (("pupil",), ("r", "right")), "heart_rate": (("heart", "hr"),),
    "gaze_x": (("gaze",), ("x", "horizontal")), "gaze_y": (("gaze",), ("y", "vertical")),
    "head_forward_x": (("head",), ("forward",), ("x",)), "head_forward_z": (("head",), ("forward",), ("z", "depth")),
}


def _words(name: str) -> list[str]:
    """A column name's words: cut at marks and where a capital follows a small letter."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", re.sub(r"[^A-Za-z0-9]+", " ", name)).lower().split()


def _has(words: list[str], part: str) -> bool:
    """Whether a part of a name occurs: short ones as words, or as what a signal's own word leaves at either end."""
    if len(part) > 2:
        return any(part in w for w in words)
    ends = [w.replace(own, " ").strip() for w in words for own in ("pupil", "gaze", "headset", "head", "forward", "dilation", "diameter", "size")]
    return part in words or part in ends


def detect_columns(columns: Sequence[str]) -> dict[str, str]:
    """Signals that column names suggest: for each the first name that holds one of each of its groups of parts, in any case."""
    named = [(c, _words(c)) for c in columns]
    found = {k: next((c for c, w in named if all(any(_has(w, p) for p in parts) for parts in groups)), None) for k, groups in _SIGNS.items()}
    return {k: c for k, c in found.items() if c}


def load_points(spark: SparkSession, path: str, pattern: str = "*.csv", mapping: ColumnMapping | None = None, *, require_time: bool = False, scale: float = 1.0, motion_threshold: float = 0.001, trim: bool = True, positional: bool = False, full_name: bool = False, count_time: bool = False) -> DataFrame:
    """A folder of files, one trajectory each (the id is the file's stem, or with full_name its name), as points.

    Tab-separated (.tsv), Parquet (.parquet, .pq) or else comma-separated files; rows keep their order in the file. Rows
    without both coordinates go, and what lies before the first motion unless trim is off. Files without columns for x and
    z, with texts in them, empty or broken ones are left out; file_problems() lists them, and it is an error if no file is
    good. With positional, missing x, z and t columns are the first three; with count_time a missing time is the row's number.
    """
    raw = parsed(spark, path, pattern, asdict(mapping or ColumnMapping()), FIELDS, positional=positional, count_time=count_time)
    good = raw.where("problem is null")
    if good.limit(1).isEmpty() and (first := raw.first()):
        raise ValueError(f"no usable file; {first['file']}: {first['problem']}")
    stem = F.col("file") if full_name else F.regexp_replace("file", r"(.)\.[^.]*$", "$1")
    return clean(good.withColumn("trajectory", stem), require_time=require_time, scale=scale, motion_threshold=motion_threshold, trim=trim)


def file_problems(spark: SparkSession, path: str, pattern: str = "*.csv", mapping: ColumnMapping | None = None, *, positional: bool = False) -> DataFrame:
    """file and problem of the files that load_points() leaves out."""
    wrong = parsed(spark, path, pattern, asdict(mapping or ColumnMapping()), FIELDS, positional=positional).where("problem is not null").select("file", "problem")
    empty = empty_files(spark, path, pattern)
    return wrong.unionByName(spark.createDataFrame([(f, "empty file") for f in empty], "file string, problem string")) if empty else wrong


def clean(rows: DataFrame, *, require_time: bool = False, scale: float = 1.0, motion_threshold: float = 0.001, trim: bool = True) -> DataFrame:
    """Points from rows with trajectory, _place (their order) and the fields: nulls for NaN, scaled, indexed from 0, trimmed."""
    cells = [number(F.col(k)).alias(k) for k in FIELDS]
    found = rows.select("trajectory", "_place", *cells).where("x is not null and z is not null")
    found = found.withColumns({k: F.col(k) * scale for k in ("x", "z")})
    whole, inner = Window.partitionBy("trajectory"), Window.partitionBy("trajectory").orderBy("_place")
    if require_time:
        found = found.withColumn("_timed", F.count("t").over(whole)).where("_timed > 0").drop("_timed")
    found = found.withColumn("idx", F.row_number().over(inner) - 1).drop("_place")
    return trim_static(found, motion_threshold) if trim else found.select("trajectory", "idx", *FIELDS)


def trim_static(points: DataFrame, motion_threshold: float = 0.001) -> DataFrame:
    """Points from the first one whose next step exceeds the threshold (all, if none does), with idx and t counted from there."""
    inner, whole = Window.partitionBy("trajectory").orderBy("idx"), Window.partitionBy("trajectory")
    step = length(F.lead("x").over(inner) - F.col("x"), F.lead("z").over(inner) - F.col("z"))
    begin = F.coalesce(F.min(F.when(F.col("_step") > motion_threshold, F.col("idx"))).over(whole), F.lit(0))
    kept = points.withColumn("_step", step).withColumn("_begin", begin).where("idx >= _begin")
    first = F.max(F.when(F.col("idx") == F.col("_begin"), F.col("t"))).over(whole)
    return kept.withColumn("t", F.col("t") - F.coalesce(first, F.lit(0.0))).withColumn("idx", F.col("idx") - F.col("_begin")).drop("_step", "_begin")


def capabilities(points: DataFrame) -> DataFrame:
    """trajectory with has_time, has_gaze, has_physio and has_headset: all of a group's signals occur."""
    seen = lambda *cs: F.least(*[F.count(c) for c in cs], F.lit(1)) > 0
    gaze, physio = seen("head_forward_x", "head_forward_z", "gaze_x", "gaze_y"), seen("pupil_l", "pupil_r", "heart_rate")
    return points.groupBy("trajectory").agg((F.count("t") > 0).alias("has_time"), gaze.alias("has_gaze"), physio.alias("has_physio"), (gaze & physio).alias("has_headset"))


def with_signals(points: DataFrame) -> DataFrame:
    """Points of trajectories that have gaze or physiological signals."""
    return points.join(capabilities(points).where("has_gaze or has_physio").select("trajectory"), "trajectory", "left_semi")


def overview(points: DataFrame) -> DataFrame:
    """Trajectories, points and extents of a dataset."""
    return points.agg(F.countDistinct("trajectory").alias("trajectories"), F.count("*").alias("points"), *[f(c).alias(f"{c}_{n}") for c in ("x", "z") for n, f in (("min", F.min), ("max", F.max))])


def thinned(points: DataFrame, most: int = 1000) -> DataFrame:
    """Every n // most-th point of each trajectory, at least every one."""
    n = F.count("*").over(Window.partitionBy("trajectory"))
    return points.withColumn("_rate", F.greatest(F.lit(1), F.floor(n / most))).where("idx % _rate = 0").drop("_rate")


def sampled(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Points of k trajectories (all, if there are fewer), spread evenly over a seeded order of their ids; of one alone, the first in that order."""
    ids = points.select("trajectory").distinct().withColumn("_h", F.xxhash64(F.lit(seed), "trajectory"))
    # Evenly spaced places of the order, from its first to its last: each id's share of the 64-bit range stands for its place.
    n = ids.agg(F.count("*").alias("_all"))
    block = F.shiftright("_h", 48)
    before = ids.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # 65,536 rows at most
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_h", "trajectory")) - 1
    placed = ids.withColumn("_block", block).withColumn("_place", place).join(before, "_block").crossJoin(F.broadcast(n)).withColumn("_place", F.col("_before") + F.col("_place"))
    step = (F.col("_all") - 1) / max(1, k - 1)
    turn = F.ceil(F.col("_place") / F.when(step > 0, step))
    taken = F.when(F.col("_all") <= k, True).when(F.lit(k <= 1), F.col("_place") < k).otherwise(F.floor(turn * step) == F.col("_place"))
    return points.join(placed.where(taken).select("trajectory"), "trajectory", "left_semi")


def events_as_points(events: DataFrame) -> DataFrame:
    """An event stream as trajectories: each user's events in time order, whose kinds and values move them in the plane.

    click and view move along x, purchase and signup along z, forth and back by the value in hundredths; time is in
    units of ten hours since the user's first event; signals come from the integer in props.
    """
    inner = Window.partitionBy("trajectory").orderBy("ts", "event_id")
    run, whole = inner.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("trajectory")
    c, k = F.col("c"), F.col("k")
    cast = events.select(F.col("user_id").cast("string").alias("trajectory"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_type", F.round(F.col("value") * 100).cast("long").alias("c"), F.regexp_extract("props", "([0-9]+)", 1).try_cast("int").alias("k"))
    move = lambda forth, back: F.sum(F.when(F.col("event_type") == forth, c).when(F.col("event_type") == back, -c).otherwise(0)).over(run).cast("double") / 100.0
    none = F.lit(None).cast("double")
    cells = {
        "idx": F.row_number().over(inner) - 1,
        "x": move("click", "view"),
        "z": move("purchase", "signup"),
        "t": (F.col("ts") - F.min("ts").over(whole)) / F.lit(3.6e10),
        "head_forward_x": F.when(k % 11 != 0, (k % 7 - 3).cast("double")),
        "head_forward_y": none,
        "head_forward_z": F.when(k % 11 != 0, (k % 5 - 2).cast("double")),
        **{n: none for n in ("head_up_x", "head_up_y", "head_up_z")},
        "gaze_x": (k % 10).cast("double") / 10.0,
        "gaze_y": (k % 9).cast("double") / 10.0,
        "heart_rate": (60 + k % 40).cast("double"),
        "pupil_l": F.when(k % 13 != 0, 2.0 + (c % 300) / 100.0),
        "pupil_r": F.when(k % 13 != 0, 2.0 + ((c + 50) % 300) / 100.0),
    }
    return cast.withColumns(cells).select("trajectory", "idx", *FIELDS)


def demo_points(spark: SparkSession, walkers: int = 10, steps: tuple[int, int] = (1000, 5000), seed: int = 42) -> DataFrame:
    """Gaussian random walks from (500, 200), each of a number of steps from the first up to below the second."""
    n = steps[0] + F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, steps[1] - steps[0])))
    walk = spark.range(walkers).select(F.col("id").cast("string").alias("trajectory"), F.posexplode(F.sequence(F.lit(1), n)).alias("_place", "_k"))
    grid = walk.select("trajectory", "_place", F.randn(seed).alias("a"), F.randn(seed + 1).alias("b"))
    run = Window.partitionBy("trajectory").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    cells = {"x": 500.0 + F.sum("a").over(run), "z": 200.0 + F.sum("b").over(run), "t": F.col("_place") * 0.1, **{k: F.lit(None).cast("double") for k in SIGNALS}}
    return clean(grid.withColumns(cells))


def demo_junctions() -> list[Junction]:
    """Seven junctions of the demonstration plan. Fixed values."""
    discs = [(685, 170, 30), (550, -90, 30), (730, 440, 20), (520, 340, 40), (500, 515, 20), (575, 430, 15), (500, 205, 20)]
    return junctions(discs, [100.0, 50.0, 45.0, 45.0, 45.0, 30.0, 45.0])


#: Names of the same quantity in other tables. Fixed values.
ALIASES = {"hr_baseline": "heart_rate_baseline", "hr_decision": "heart_rate_decision", "hr_change": "heart_rate_change", "baseline_pupil": "pupil_baseline", "decision_pupil": "pupil_decision", "pupil_dilation_change": "pupil_change", "yaw": "head_yaw", "yaw_diff": "yaw_difference"}


def renamed(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """df with columns named alike whatever table they come from; an alias stays where the name is taken."""
    names = ALIASES if aliases is None else aliases
    return df.withColumnsRenamed({a: n for a, n in names.items() if a in df.columns and n not in df.columns})


def load_centers(spark: SparkSession, path: str) -> DataFrame:
    """Branch centres (junction, branch, ux, uz) from a folder of Parquet files, or of save_centers()."""
    if path.endswith(".npy"):
        files = spark.read.format("binaryFile").load(path).select("path", "content").collect()  # a few dozen bytes for each junction
        found = [(int(f["path"].rsplit("_j", 1)[1][:-4]), k, float(u[0]), float(u[1])) for f in files for k, u in enumerate(np.load(io.BytesIO(f["content"])))]
        return spark.createDataFrame(found, "junction int, branch int, ux double, uz double")
    return spark.read.parquet(path).select(F.col("junction").cast("int").alias("junction"), F.col("branch").cast("int").alias("branch"), F.col("ux").cast("double").alias("ux"), F.col("uz").cast("double").alias("uz"))


def save_centers(centers: DataFrame, path: str) -> None:
    """A file branch_centers_j<junction>.npy for each junction, with a row (ux, uz) for each branch; load_centers(path/*.npy) reads them."""
    spark, by = centers.sparkSession, {}
    for r in centers.orderBy("junction", "branch").collect():  # a junction has few branches
        by.setdefault(r["junction"], []).append((r["ux"], r["uz"]))
    for junction, rows in by.items():
        data = io.BytesIO()
        np.save(data, np.array(rows))
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/branch_centers_j{junction}.npy")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(data.getvalue()))
        out.close()


def load_assignments(spark: SparkSession, path: str) -> DataFrame | None:
    """trajectory and branch from CSV files, or None where a column is missing (then branches have to be discovered)."""
    raw = spark.read.csv(path, header=True)
    if not {"trajectory", "branch"} <= set(raw.columns):
        return None
    return raw.select("trajectory", F.col("branch").try_cast("int").alias("branch"))


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result as parquet, csv or json. NaN and infinities become null in json."""
    if kind == "json":
        df = df.withColumns({c: number(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


#: Artefacts of a discovery by name. Fixed values.
ARTEFACTS = ("branch_assignments", "branch_assignments_all", "branch_summary", "branch_summary_all", "decision_points", "decision_mode_used", "discover_diagnostics", "vectors", "timing_and_speed_metrics", "gaze_analysis", "physiological_analysis", "pupil_trajectory_analysis", "intent_recognition_summary", "intent_recognition_junction_summary")


def save_results(results: dict[str, DataFrame], path: str, kind: str = "csv") -> list[str]:
    """Each result in a folder of its name (one of ARTEFACTS, or branch_assignments_j0 and the like) under path; the folders written."""
    odd = [n for n in results if not n.startswith(ARTEFACTS)]
    if odd:
        raise ValueError(f"unknown artefacts: {', '.join(odd)}")
    for name, df in results.items():
        save(df, f"{path}/{name}", kind)
    return [f"{path}/{n}" for n in results]


def run_arguments(**values) -> str:
    """A command's arguments as JSON."""
    return json.dumps(values, sort_keys=True, default=lambda v: asdict(v) if hasattr(v, "__dataclass_fields__") else str(v))


