import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strideline.llm import catalog, simhash
from strideline.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute_print(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), k) if x is not None), default=None)
    return sorted(((k, f"{p:016x}", least[find(i)]) for i, ((k, _), p) in enumerate(zip(rows, prints))), key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert result(catalog.op1_simhash(spark, SF)) == brute([tuple(r) for r in docs])


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d e"), (5, "A B C D E"), (5, "A B C D E"), (6, long), (7, long + " end"), (8, "one"), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("x")).withColumn("component_id", F.lit(0))
    assert result(simhash.near_duplicates(docs, words=4)) == brute(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 5, 6, 8]


def test_forest_spans_all_links():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = base[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    values = np.concatenate((base, near)).reshape(-1, 1)
    values = values[np.lexsort(simhash._sections(values, 4).T[::-1])]
    rows, roots = simhash._forest(values, values, True, 4, 4)
    assert len(rows) == 100
    assert all((int(values[i, 0]) ^ int(values[j, 0])).bit_count() <= 4 for i, j in zip(rows, roots))


def test_keep_one_keeps_unrelated_short_texts(spark):
    rng = np.random.default_rng(5)
    short = lambda k, n: " ".join(f"{chr(97 + w % 26)}{w}" for w in rng.integers(0, 10**9, n))
    texts = ["", " \n", None, *(short(k, 6 + k % 2 * 2) for k in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {0, *range(3, len(texts))}


def test_two_step_comparison_finds_all_near_fingerprints():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, (150, 8), dtype=np.uint64)
    flips = rng.integers(0, 2, (150, 8, 64)) * (rng.random((150, 8, 64)) < np.linspace(0, 0.6, 150)[:, None, None])
    values = np.concatenate((base, base ^ np.packbits(flips.astype(np.uint8), axis=2).view(">u8")[:, :, 0].astype(np.uint64), ~base[:9]))
    apart = np.bitwise_count(values[:, None] ^ values[None]).sum(axis=2, dtype=np.int64)
    for radius in (0, 40, 102, 260):
        found = set(zip(*(x.tolist() for x in simhash._within(values, values, radius))))
        assert found == set(zip(*(x.tolist() for x in np.nonzero(apart <= radius))))


def test_texts_that_repeat_one_phrase_are_not_alike(spark):
    other = lambda k: " ".join(f"{chr(97 + w % 26)}{w}" for w in np.random.default_rng(k).integers(0, 10**9, 40))
    texts = [f"{other(k)} " + "again " * 400 for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 20


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 4), (9, 9), (None, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(49, 70), (70, 71)]])
def test_components(spark, edges):
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root.get(a, {a}), root.get(b, {b})
            for x in ra | rb:
                root[x] = ra | rb
    assert found == {k: min(v) for k, v in root.items()}
