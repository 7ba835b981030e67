"""Runs queries of the catalog and their SQL over one folder of tables and reports what differs."""

import math
import sys
import time
from pathlib import Path

import duckdb


def views(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def tidy(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(tidy(r[k]) for k in order) for r in found), key=str)


def compare(spark, c, query, sql, sf_dir):
    df = query(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    rel = c.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if ours != theirs:
        odd = [x for x in zip(ours, theirs) if x[0] != x[1]][:3]
        return f"{len(ours)} and {len(theirs)} rows; {odd}"
    return None if ours else "both are empty"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    from strideline.plans import catalog

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", "file:///tmp/strideline-compare").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, q, o = sys.argv[1], catalog.queries(), catalog.oracle_sql()
    c = views(sf)
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            said = compare(spark, c, q[name], o[name], sf) if name in o else f"{q[name](spark, sf).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = str(e)[:600]
        print(name, f"{time.time() - t:.1f}s", said or "equal", flush=True)
