import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.oracle import rows, spark_rows
from strideline.llm import catalog, codes


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert spark_rows(catalog.op11_codes(spark, sf)) == rows(catalog.OP11_SQL, sf)


def brute(data, parts, entries, rounds):
    """Lloyd over every part of every row, in Python integers."""
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, _, v in kept), default=0) // parts))
    kept = [(i, lab, v + [0] * (width * parts - len(v))) for i, lab, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    books = [[v[p * width : (p + 1) * width] for _, _, v in kept[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    cut = lambda v, p: v[p * width : (p + 1) * width]
    for _ in range(rounds):
        new = []
        for p in range(parts):
            mine = [(near(p, cut(v, p))[1], cut(v, p)) for _, _, v in kept]
            new.append([[sum(c) // len(xs) for c in zip(*xs)] if (xs := [x for k, x in mine if k == e]) else old for e, old in enumerate(books[p])])
        books = new
    found = [(i, lab, [near(p, cut(v, p)) for p in range(parts)]) for i, lab, v in kept]
    totals = {}
    for _, lab, f in found:
        totals[lab] = totals.get(lab, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), totals[lab], sha) for i, lab, f in found), key=str)


def odd(n):
    r = np.random.default_rng(5)
    data = [(int(i), [float(x) for x in r.normal(0, 3, 8).round(1)], int(i) % 4 if i % 5 else None) for i in r.permutation(n)]
    data += [(7, data[0][1], 1), (7, data[0][1], 1), (7, [0.0] * 8, 1), (None, [1.5] * 8, 2), (1, None, 1), (2, [1.0, None] * 4, 1), (3, [float("nan")] * 8, 1), (4, [float("-inf")] * 8, 1), (5, [], 3), (6, [2.0, -2.0], 3), (9, [-0.001] * 8, None)]
    return data + [(100 + i, [4.0] * 8, 9) for i in range(40)]


@pytest.mark.parametrize(("n", "parts", "entries", "rounds"), [(60, 4, 6, 2), (60, 3, 5, 3), (2, 4, 64, 2), (30, 4, 1, 0)])
def test_equals_brute_force(spark, n, parts, entries, rounds):
    data = odd(n)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumns({"row": F.lit(1), "place": F.lit("x"), "error": F.lit(2), "cells": F.lit(0)}).repartition(3)
    held = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in data]
    found = codes.summary(df, parts=parts, entries=entries, rounds=rounds)
    assert sorted(map(tuple, found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str) == brute(held, parts, entries, rounds)


def test_codes_and_books_give_the_errors(spark):
    data = [x for x in odd(50) if x[1] is not None and len(x[1]) == 8]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    coded, books = codes.compress(df, parts=4, entries=7)
    assert books.shape == (4, 7, 2)
    cells = df.where("vec_id >= 100").first()["embedding"]
    for r in coded.where("vec_id >= 100").collect():
        assert r["errors"] == [int(((np.array(cells[2 * p : 2 * p + 2]) * 256 - books[p, c]) ** 2).sum()) for p, c in enumerate(r["codes"])]


def test_tables_without_whole_vectors_and_components_out_of_range(spark):
    empty = spark.createDataFrame([(1, None, 1), (2, [None], None)], "vec_id long, embedding array<float>, label int")
    for df in (empty, empty.limit(0)):
        found = codes.summary(df)
        assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not found.collect()
    big = spark.createDataFrame([(1, [1e30], "a")], "vec_id long, embedding array<double>, label string")
    with pytest.raises(Exception, match="out of range"):
        codes.summary(big).collect()
