import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm.oracle import rows, spark_rows
from strideline.llm import catalog, shards


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert spark_rows(catalog.op3_shards(spark, sf)) == rows(catalog.OP3_SQL, sf)


def brute(data, limit):
    """Splits buckets one bit at a time."""
    bits = lambda k: bin(int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) + (1 << 60))[3:]
    out, todo = {}, [("", [(bits(k), k, len((t or "").encode())) for k, t in data])]
    while todo:
        prefix, held = todo.pop()
        if len(held) == 1 or sum(x[2] for x in held) <= limit:
            out |= {x[1]: prefix for x in held}
        else:
            for b in "01":
                some = [x for x in held if x[0].startswith(prefix + b)]
                if some:
                    todo.append((prefix + b, some))
    return out


def test_splits(spark):
    data = [(k, "é" * (k % 37)) for k in range(500)] + [(1000, "x" * 5000), (None, None), (1001, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("hash", F.lit("x")).withColumn("shard", F.lit(1)).repartition(3)
    for limit in (100, 1000, 10**9):
        found = shards.shard(docs, limit=limit).collect()
        assert {r["doc_id"]: r["shard"] for r in found} == brute(data, limit)
        assert {r["doc_id"]: r["n_bytes"] for r in found} == {k: len((t or "").encode()) for k, t in data}
    assert shards.shard(docs.limit(0)).count() == 0


def test_repeated_key(spark):
    data = [(7, "y" * 10)] * 300 + [(k, "z" * 10) for k in range(20, 60)]
    found = shards.shard(spark.createDataFrame(data, "doc_id long, text string"), limit=200).collect()
    sizes = defaultdict(int)
    for r in found:
        sizes[r["shard"]] += r["n_bytes"]
    assert len(found) == 340 and max(sizes.values()) <= 200
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_written(spark, tmp_path):
    docs = spark.createDataFrame([(k, "t" * 50) for k in range(40)], "doc_id long, text string")
    shards.write_shards(docs, f"{tmp_path}/out", limit=500)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 40
    assert back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] <= 500


def test_written_with_columns_of_the_same_names(spark, tmp_path):
    docs = spark.createDataFrame([(k % 13, "t" * 50, f"mine{k}", k, k, k) for k in range(40)], "doc_id long, text string, shard string, _id int, c0 int, _home int")
    shards.write_shards(docs, f"{tmp_path}/out", limit=500)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.columns == [*docs.columns, "_shard"]
    assert sorted(map(tuple, back.drop("_shard").collect())) == sorted(map(tuple, docs.collect()))
    assert back.select("doc_id", "_shard").distinct().count() == 13


def test_native(spark):
    plan = shards.shard(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
