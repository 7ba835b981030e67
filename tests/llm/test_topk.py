import math

import pytest
from pyspark.sql import functions as F

from llm.oracle import rows, spark_rows
from strideline.llm import catalog, topk


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert spark_rows(catalog.op2_topk(spark, sf)) == rows(catalog.OP2_SQL, sf)


def brute(data, k, every):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in ok if i != q[0])[:k]
        out += [(q[0], n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 1024), (3, 2)])
def test_edge_cases(spark, blocks):
    data = [(0, [1.0, -2.0, 3.0]), (1, [0.5, 0.5, 0.5]), (2, [0.5, 0.5, 0.5]), (2, [0.5, 0.5, 0.5]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, [-1.0, -1.0, -1.0]), (None, [9.0, 9.0, 9.0]), (8, []), (10, [2.0]), (10, [2.0]), (20, [1e30, -1e30, 2.0]), (21, [1e6, 1e6, 1e6, 1e6, 1e6]), (30, [0.0001, -0.0001, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    for k in (2, 10):
        found = topk.top_k(df, F.col("vec_id") % 10 == 0, k=k, rows_per_block=blocks[0], queries_per_block=blocks[1])
        assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == brute(data, k, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("blocks", [(8192, 1024), (2, 1)])
def test_scores_beyond_64_bits_are_ranked(spark, blocks):
    big = [(k, [s * 1e30 * (1 + k / 16), 1e20]) for k in range(12) for s in (1 if k % 3 else -1,)] + [(50, [1.0, 1.0]), (60, [1e30, -1e30]), (70, [2.0**43, 0.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in big}
    for k in (3, 20):
        found = topk.top_k(df, F.col("vec_id") % 10 == 0, k=k, rows_per_block=blocks[0], queries_per_block=blocks[1])
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()}
        for q in (i for i in whole if i % 10 == 0):
            order = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:k]
            assert [got[q, n + 1] for n in range(len(order))] == [i for _, i in order]
