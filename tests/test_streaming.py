from datetime import datetime, timedelta

from strideline.plans.params import Junction
from strideline.streaming import live

AT = [Junction(0, 0, 0, 2), Junction(1, 10, 0, 2)]
START = datetime(2024, 1, 1)


def test_visits_across_batches(spark, tmp_path):
    spots = [("a", [0, 1, 5, 0, 10, 5]), ("b", [5, 10, 10, 0, 5, 5])]
    rows = [[(k, START + timedelta(minutes=i), float(xs[i]), 0.0) for k, xs in spots for i in part] for part in ((0, 1, 2), (3, 4, 5))]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, "trajectory string, ts timestamp, x double, z double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("trajectory string, ts timestamp, x double, z double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.live_visits(stream, AT).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    found = sorted((r["trajectory"], r["visit"], r["junction"], r["previous"]) for r in spark.table("live").collect())
    assert found == [("a", 0, 0, None), ("a", 1, 0, 0), ("a", 2, 1, 0), ("b", 0, 1, None), ("b", 1, 0, 1)]


def test_windows(spark):
    rows = [("a", START, 0.0, 0.0), ("a", START + timedelta(minutes=70), 10.0, 0.0), ("b", START, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "trajectory string, ts timestamp, x double, z double")
    found = sorted((r["junction"], r["points"], r["trajectories"]) for r in live.entries_per_window(df, AT).collect())
    assert found == [(0, 2, 2), (1, 1, 1)]
