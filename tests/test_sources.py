import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideline.functions.geometry import seconds, wrapped
from strideline.operators import enhanced, flows, gaze
from strideline.plans import params
from strideline.plans.params import Decision, Junction, Zone
from strideline.sources import points as source
from strideline.sources.files import column_seconds


def test_folder_of_files(spark, tmp_path):
    for k in range(3):
        lines = [f"{0.1 * i},{i + 0.1 * k},{i + 0.1 * k}" for i in range(5)]
        (tmp_path / f"traj_{k}.csv").write_text("\n".join(["t,x,z", "0,0,", *lines]) + "\n")
    (tmp_path / "notes.txt").write_text("x")
    p = source.load_points(spark, str(tmp_path), scale=2.0)
    rows = p.where("trajectory = 'traj_1'").orderBy("idx").collect()
    assert [r["idx"] for r in rows] == [0, 1, 2, 3, 4] and [round(r["x"], 6) for r in rows] == [0.2, 2.2, 4.2, 6.2, 8.2]
    assert p.select("trajectory").distinct().count() == 3
    assert source.capabilities(p).first()["has_gaze"] is False
    with pytest.raises(ValueError):
        source.load_points(spark, str(tmp_path), mapping=source.ColumnMapping(x="X"))
    assert source.load_points(spark, str(tmp_path), mapping=source.ColumnMapping(x="X", z="Z", t="T"), positional=True, trim=False).count() == 18
    source.save(p, f"{tmp_path}/out", "csv")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 15


def test_trim_and_nulls(spark):
    rows = [("a", 0, 1.0, 1.0, 5.0), ("a", 1, 1.0, 1.0, 6.0), ("a", 2, 1.0, 1.0, 7.0), ("a", 3, 4.0, 1.0, 8.0), ("a", 4, float("nan"), 1.0, 9.0), ("b", 0, 0.0, 0.0, None), ("b", 1, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "trajectory string, _place int, x double, z double, t double").withColumns({c: F.lit(None).cast("double") for c in source.SIGNALS})
    got = sorted((r["trajectory"], r["idx"], r["t"]) for r in source.clean(df).collect() if r["trajectory"] == "a")
    assert got == [("a", 0, 0.0), ("a", 1, 1.0)]
    assert source.clean(df).where("trajectory = 'b'").count() == 2  # never moves: all stay
    assert source.clean(df, require_time=True).where("trajectory = 'b'").count() == 0


def test_time_texts(spark):
    rows = [("01:02:03.500",), ("Time: 1.23",), ("1.23s",), ("7",), ("none",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(seconds(F.col("s"))).collect()]
    assert got == [3723.5, 1.23, 1.23, 7.0, None, None]
    assert [r[0] for r in spark.createDataFrame([(190.0,), (-190.0,), (180.0,)], "d double").select(wrapped(F.col("d"))).collect()] == [-170.0, 170.0, -180.0]


def test_parameters():
    assert source.ColumnMapping.parse("x=X, z=Z").x == "X"
    with pytest.raises(ValueError):
        source.ColumnMapping.parse("yaw=Y")
    with pytest.raises(ValueError):
        Decision(mode="other")
    with pytest.raises(ValueError):
        params.junctions([(0, 0, 1)], [2, 3])
    assert params.junctions([(0, 0, 1), (1, 1, 2)])[1].ring == 12.0
    with pytest.raises(ValueError):
        Decision(mode="radial", linger_delta=9).checked([Junction(0, 0, 0, 5, 9)])
    assert Decision(mode="radial", linger_delta=9).checked([Junction(0, 0, 0, 5, 9)], strict=False).linger_delta < 4
    assert params.regions('{"A": {"rect": [0, 1, 0, 2]}, "B": {"circle": [1, 2, 3]}}')["B"].circle == (1, 2, 3)
    assert params.config({"defaults": {"a": {"b": 1, "c": 2}}, "run": {"a": {"c": 3}}}, "run") == {"a": {"b": 1, "c": 3}}
    assert source.detect_columns(["Headset.PupilDilation.L", "Headset.HeartRate", "Gaze_X"]) == {"pupil_l": "Headset.PupilDilation.L", "heart_rate": "Headset.HeartRate", "gaze_x": "Gaze_X"}
    named = source.detect_columns(["HR", "PupilLeft", "PupilRight", "gaze_horizontal", "gaze_vertical", "HeadForwardX", "head.forward.depth"])
    assert named == {"heart_rate": "HR", "pupil_l": "PupilLeft", "pupil_r": "PupilRight", "gaze_x": "gaze_horizontal", "gaze_y": "gaze_vertical", "head_forward_x": "HeadForwardX", "head_forward_z": "head.forward.depth"}


def walk(spark, spots):
    rows = [("w", i, float(x), 0.0, float(i)) for i, x in enumerate(spots)]
    return spark.createDataFrame(rows, "trajectory string, idx int, x double, z double, t double").withColumns({c: F.lit(None).cast("double") for c in source.SIGNALS})


def test_visits_and_second_order(spark):
    at = [Junction(0, 0, 0, 2), Junction(1, 10, 0, 2), Junction(2, 1, 0, 2)]
    seen = flows.visits(walk(spark, [0, 1, 5, 0, 5, 10, 5, 10, 5, 0, 20]), at)
    assert [r["junction"] for r in seen.orderBy("visit").collect()] == [0, 0, 1, 1, 0]
    assert [tuple(r) for r in flows.before(seen).select("via", "dest", "origin").where("via = 1 and dest = 0").collect()] == [(1, 0, 0)]
    assert flows.next_choice(flows.after(seen), 0, 7) == ("Unknown", 0.0)
    zones = flows.visits_with_zones(walk(spark, [-30, 0, 10, 40]), at[:2], [Zone("S", circle=(-30, 0, 1))], [Zone("E", rectangle=(39, 41, -1, 1))])
    assert [r["junction"] for r in zones.orderBy("visit").collect()] == ["S", "J0", "J1", "E"]


def test_enhanced(spark):
    rows = [(str(k), 0, 0 if k < 85 else 1) for k in range(100)] + [(str(k), 1, k % 2) for k in range(10)]
    df = spark.createDataFrame(rows, "trajectory string, junction int, branch int")
    assert [tuple(r)[3:] for r in enhanced.bottlenecks(df).collect()] == [(0.85, "HIGH")]
    risk = {r["junction"]: r["risk"] for r in enhanced.risk(df).collect()}
    assert risk[0] == pytest.approx((0.15 / 0.3 + 0.3 + 1) / 3) and risk[1] == pytest.approx(0.1)
    assert [r["junction"] for r in enhanced.balanced(df).collect()] == [1]
    assert enhanced.recommendations(df).count() >= 1


def test_heatmap_edges(spark):
    rows = [("w", i, float(x), float(x), None, p, p) for i, (x, p) in enumerate([(0, 2.0), (5, 4.0), (10, 3.0)])]
    df = spark.createDataFrame(rows, "trajectory string, idx int, x double, z double, t double, pupil_l double, pupil_r double")
    box = tuple(F.lit(v) for v in (0.0, 10.0, 0.0, 10.0))
    mean = {(r["ix"], r["iz"]): r["value"] for r in gaze.pupil_heatmap(df, cells=2, box=box).collect()}
    assert mean == {(0, 0): pytest.approx(-100 / 3), (1, 1): pytest.approx(100 / 6)}
    top = {(r["ix"], r["iz"]): r["n"] for r in gaze.pupil_heatmap(df, cells=2, combine="max", box=box).collect()}
    assert top == {(0, 0): 1, (1, 1): 1}
    scale = gaze.common_scale(gaze.pupil_heatmap(df, cells=2, box=box)).first()
    assert tuple(scale) == (-50.0, 50.0) and math.isclose(sum(mean.values()), -100 / 6)


def test_a_bad_file_spoils_no_other(spark, tmp_path):
    files = {
        "good.csv": "t,x,z\n0,0,0\n1,1,1\n2,2,", "other.csv": "a,b\n1,2\n", "text.csv": "x,z\n1,here\n", "empty.csv": "\n \n", "nothing.csv": "", "head.csv": "x,z\n", "wide.csv": "x,z\n1,2,3,4\n", "moved.csv": "z,Extra,x\n5,a,1\n6,b,2\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 no")
    found = {(r["trajectory"], r["idx"]): (r["x"], r["z"]) for r in source.load_points(spark, str(tmp_path), trim=False).collect()}
    assert found == {("good", 0): (0, 0), ("good", 1): (1, 1), ("moved", 0): (1, 5), ("moved", 1): (2, 6)}
    assert {r["file"] for r in source.file_problems(spark, str(tmp_path)).collect()} == {"other.csv", "text.csv", "empty.csv", "wide.csv", "nothing.csv"}
    assert [r["file"] for r in source.file_problems(spark, str(tmp_path), "*.parquet").collect()] == ["broken.parquet"]
    with pytest.raises(ValueError, match="broken"):
        source.load_points(spark, str(tmp_path), "*.parquet")
    (tmp_path / "tabs.tsv").write_text("x\tz\tt\n1\t2\t0 days 00:00:01.5\n3\t4\t00:00:02\n")
    assert [r["t"] for r in source.load_points(spark, str(tmp_path), "*.tsv", trim=False).orderBy("idx").collect()] == [1.5, 2.0]
    spark.range(3).selectExpr("cast(id as double) x", "id z", "'7s' t").coalesce(1).write.parquet(f"{tmp_path}/pq")
    assert source.load_points(spark, f"{tmp_path}/pq", "*.parquet").count() == 3
    assign = dict(mapping=source.ColumnMapping(x="X", z="Z", t="T"), positional=True, trim=False, full_name=True, count_time=True)
    with pytest.raises(ValueError, match="Extra"):  # its second column holds texts
        source.load_points(spark, str(tmp_path), "moved.csv", **assign)
    (tmp_path / "plain.csv").write_text("p,q\n5,6\n5,6\n7,8\n")
    assigned = source.load_points(spark, str(tmp_path), "plain.csv", **assign).orderBy("idx").collect()
    assert [(r["trajectory"], r["idx"], r["x"], r["z"], r["t"]) for r in assigned] == [("plain.csv", 0, 5, 6, 0), ("plain.csv", 1, 5, 6, 1), ("plain.csv", 2, 7, 8, 2)]


def test_columns_of_times(spark):
    columns = {"a": ["1", "2.5", None], "b": ["00:00:01.250", "x", "01:00:00.000"], "c": ["Time: 1.23", "4s", "none"], "d": ["3", "x", "00:00:01.000"], "e": ["0 days 00:00:01.5", "00:00:02", None]}
    expected = {"a": [1.0, 2.5, None], "b": [1.25, None, 3600.0], "c": [1.23, 4.0, None], "d": [3.0, None, None], "e": [1.5, 2.0, None]}
    for k, vs in columns.items():
        assert [None if v != v else v for v in column_seconds(pd.Series(vs, dtype=object)).astype(float)] == expected[k]


def test_a_file_of_many_ranges(spark, tmp_path):
    """Files in ranges of a few hundred bytes give the points and problems of files in one."""
    times = {"clock": lambda i: f"00:{i // 60:02d}:{i % 60:02d}.250", "number": lambda i: str(i / 4), "mixed": lambda i: "x" if i == 350 else f"{i}", "lengths": lambda i: f"0 days 00:00:{i % 60:02d}"}
    for name, t in times.items():
        (tmp_path / f"{name}.csv").write_text("note,x,t,z\n" + "".join(f"a{i},{i * 0.5},{t(i)},{'' if i % 50 == 7 else -i}\n" for i in range(400)) + "short,1\n")
    (tmp_path / "late text.csv").write_text("x,z\n" + "".join(f"{i},{i}\n" for i in range(300)) + "here,1\n" + "".join(f"{i},{i}\n" for i in range(300)))
    (tmp_path / "late+wide.csv").write_text("x,z\r\n" + "".join(f"{i},{i}\r\n" for i in range(300)) + "1,2,3\r\n")
    (tmp_path / "no z.csv").write_text("x,y\n" + "1,2\n" * 500)
    (tmp_path / "nothing.csv").write_text("")
    read = lambda: ({(r["trajectory"], r["idx"]): (r["x"], r["z"], r["t"]) for r in source.load_points(spark, str(tmp_path), trim=False).collect()}, sorted(map(tuple, source.file_problems(spark, str(tmp_path)).collect())))
    whole = read()
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "700")
    try:
        assert spark.read.text(f"{tmp_path}/clock.csv").rdd.getNumPartitions() >= 10
        ranges = read()
        numbered = source.load_points(spark, str(tmp_path), "no z.csv", positional=True, count_time=True, trim=False)
        assert [r["t"] for r in numbered.orderBy("idx").collect()] == [float(k) for k in range(500)]
    finally:
        spark.conf.unset(key)
    assert ranges == whole
    points, problems = whole
    assert {f for f, _ in problems} == {"late text.csv", "late+wide.csv", "no z.csv", "nothing.csv"}
    assert {k for k, _ in points} == set(times) and all(sum(k == name for k, _ in points) == 392 for name in times)
    assert [points["clock", i][2] for i in (0, 1)] == [0.25, 1.25] and points["mixed", 345][2] is not None


def test_detected_sides():
    assert source.detect_columns(["PupilRight", "PupilLeft", "threshold"]) == {"pupil_l": "PupilLeft", "pupil_r": "PupilRight"}
    assert source.detect_columns(["pupil_r", "pupil_l", "HR_bpm"]) == {"pupil_l": "pupil_l", "pupil_r": "pupil_r", "heart_rate": "HR_bpm"}
    assert source.detect_columns(["RPupil", "LPupil", "heartbeat"]) == {"pupil_l": "LPupil", "pupil_r": "RPupil", "heart_rate": "heartbeat"}
    assert source.detect_columns(["pupilL", "threshold", "gaze_pixel"]) == {"pupil_l": "pupilL"}


def test_json_and_arguments(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, float("nan")), (2, float("inf"), None)], "k int, a double, b double")
    source.save(df, f"{tmp_path}/out", "json")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(f"{tmp_path}/out").collect())) == [(1, 0.5, None), (2, None, None)]
    said = json.loads(source.run_arguments(at=[Junction(0, 1, 2, 3)], how=Decision(mode="radial"), path=tmp_path))
    assert said["at"][0]["cx"] == 1 and said["how"]["mode"] == "radial" and said["path"] == str(tmp_path)


def test_which_trajectories_are_sampled(spark):
    df = spark.createDataFrame([(f"t{k}", 0) for k in range(50)], "trajectory string, idx int")
    order = [r[0] for r in df.orderBy(F.xxhash64(F.lit(7), "trajectory")).collect()]
    for k in (1, 2, 5, 13, 50):
        spots = {int(i * 49 / max(1, k - 1)) for i in range(k)} if k > 1 else {0}
        assert {r[0] for r in source.sampled(df, k, 7).collect()} == {order[i] for i in spots}


def test_demo_and_samples(spark):
    p = source.demo_points(spark, 6, (20, 60))
    sizes = {r["trajectory"]: r["count"] for r in p.groupBy("trajectory").count().collect()}
    assert len(sizes) == 6 and all(10 < n < 60 for n in sizes.values()) and len(set(sizes.values())) > 1
    for k, n in ((0, 0), (1, 1), (3, 3), (5, 5), (6, 6), (9, 6)):
        assert source.sampled(p, k).select("trajectory").distinct().count() == n
    assert len(source.demo_junctions()) == 7 and source.demo_junctions()[3].ring == 45.0
    assert source.renamed(spark.createDataFrame([(1, 2)], "hr_change int, yaw int")).columns == ["heart_rate_change", "head_yaw"]


def test_centers_and_results(spark, tmp_path):
    centers = spark.createDataFrame([(0, 0, 1.0, 0.0), (0, 1, 0.0, 1.0), (3, 0, -1.0, 0.0)], "junction int, branch int, ux double, uz double")
    source.save_centers(centers, f"file://{tmp_path}/centers")
    assert sorted(map(tuple, source.load_centers(spark, f"file://{tmp_path}/centers/*.npy").collect())) == sorted(map(tuple, centers.collect()))
    centers.write.parquet(f"{tmp_path}/pq")
    assert source.load_centers(spark, f"{tmp_path}/pq").count() == 3
    written = source.save_results({"vectors": centers, "branch_assignments_j0": centers}, f"file://{tmp_path}/out")
    assert [spark.read.csv(p, header=True).count() for p in written] == [3, 3]
    with pytest.raises(ValueError):
        source.save_results({"other": centers}, f"file://{tmp_path}/out")
    a = spark.createDataFrame([("a", "1"), ("b", "-1"), ("c", "x")], "trajectory string, branch string")
    a.write.option("header", True).csv(f"{tmp_path}/assigned")
    assert sorted((r["trajectory"], r["branch"]) for r in source.load_assignments(spark, f"{tmp_path}/assigned").where("branch is not null").collect()) == [("a", 1), ("b", -1)]
    a.select("trajectory").write.option("header", True).csv(f"{tmp_path}/none")
    assert source.load_assignments(spark, f"{tmp_path}/none") is None
