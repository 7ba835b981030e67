import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strideline.llm import catalog, quality, simhash, templates, toxicity

SF = "/root/testdata/sf0.001"


def sets(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def linked(texts):
    """Pairs of places whose fingerprints are 0.8 similar, by comparing all; wordless texts are linked with one another only."""
    found, prints = [sets(t) for t in texts], [int.from_bytes(simhash.fingerprint((t or "").encode(), 5, 512, unique=True)) for t in texts]
    pairs = [(i, j) for i in range(len(found)) for j in range(i) if bool(found[i]) == bool(found[j]) and (prints[i] ^ prints[j]).bit_count() <= 102]
    for i, j in pairs:  # no pair is linked by chance
        assert not found[i] or len(found[i] & found[j]) >= 0.6 * (len(found[i]) * len(found[j])) ** 0.5
    return pairs


def groups(rows):
    """Least id of each document's group."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked([t for _, t in rows]):
        a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
        root[b] = a
    return {rows[find(i)][0] for i in range(len(rows))}


def test_every_stage_against_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF)
        assert k == 4 or found.columns == columns
        found.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        out[name] = before, docs
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    before, after = out["quality classifier"]
    judged = quality.classify(before, catalog.quality_model(spark, SF))
    assert ids(after) == ids(judged.where("predicted = 1"))
    before, after = out["toxicity"]
    judged = toxicity.classify(before, catalog.toxicity_model(spark, SF))
    assert ids(after) == ids(judged.where("predicted = 0"))
    before, after = out["line dedup"]
    expected = {r["doc_id"]: r["text"] for r in templates.line_dedup(before).collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == expected and set(expected) == ids(before)
    assert after.where(F.col("n_chars") != F.length("text")).count() == 0
    before, after = out["simhash near-dedup"]
    assert ids(after) == groups([(r["doc_id"], r["text"]) for r in before.collect()])
    before, after = out["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = [r.asDict() for r in after.collect()]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    tokens = {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    assert all(zlib.crc32(np.array(tokens[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)
    assert sum(p["length"] for p in pieces) == sum(map(len, tokens.values()))
    assert ids(after) == ids(before)


def test_near_duplicates_of_more_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()}
    assert kept == groups(rows) and len(kept) < len({t for _, t in rows})


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "word " * 30_000), (6, "word " * 30_000), (None, "a few plain words here."), (None, None)]


def small_tables(spark, path, docs, labels):
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(k, t, "en", None, None if t is None else len(t)) for k, t in docs]
    spark.createDataFrame(rows, fields).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_run_over_odd_rows(spark, tmp_path):
    known = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    docs = [(r["doc_id"] + 100, r["text"]) for r in known]
    small_tables(spark, f"{tmp_path}/a", [*docs, *ODD], [*[(k + 100, q, t) for k, q, t in labels], (None, 1, 0), (1, None, None), (2, 1, 1), (2, 0, 0)])
    out = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert rows and all(sum(n for _, n in v) == 2048 for k, v in by.items() if k < max(by))


def test_run_without_rows_or_labels(spark, tmp_path):
    small_tables(spark, f"{tmp_path}/none", [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    small_tables(spark, f"{tmp_path}/plain", [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, None), (4, "")], [])
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/plain").collect()}
    assert kept == set()
