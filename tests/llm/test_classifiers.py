import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.llm import catalog, quality, toxicity
from strideline.llm.linear import fold

SF = "/root/testdata/sf0.1"


def area(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize(("query", "label", "parts", "held", "least", "accuracy"), [(catalog.op7_quality, "quality", 5, 0, 0.99, 0.98), (catalog.op10_toxicity, "toxic", 4, 2, 0.95, 0.96)])
def test_held_out(spark, query, label, parts, held, least, accuracy):
    found = query(spark, SF).toPandas()
    assert found.columns.tolist() == ["doc_id", "held_out", "score", "predicted"] and len(found) == 10_000
    assert [zlib.crc32(str(k).encode()) % parts == held for k in found.doc_id] == found.held_out.tolist()
    assert found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()
    d = found[found.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert area(d.score.to_numpy(), d[label].to_numpy()) >= least
    assert (d.predicted == d[label]).mean() >= accuracy


ROWS = [(1, None), (2, ""), (None, "word"), (3, "same text"), (3, "same text"), (4, "W " * 50_000), (5, "\n \t")]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_cases(spark, module):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("y", F.lit(9)).withColumn("score", F.lit("x")).withColumn("upper", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.train(docs, none, F.lit(True))
    out = module.classify(docs, model).collect()
    assert len(out) == len(ROWS) and {r["score"] for r in out} == {0.5}
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    assert module.classify(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, None, None), (3, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    model = module.train(docs, labels, fold("doc_id", 5) != 99)
    assert all(0 <= r["score"] <= 1 for r in module.classify(docs, model).collect())
    kept = (quality.keep_good if module is quality else toxicity.drop_toxic)(docs, model, threshold=0.0 if module is quality else 1.1)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_rules_as_columns_equal_numpy(spark):
    rng = np.random.default_rng(3)
    texts = [(k, " ".join(rng.choice(["Aa", "b!", "c1", "dd,", "é"], rng.integers(0, 40)))) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    x = quality._describe([t.encode() for _, t in texts])
    y = (x[:, 1] > 0.1).astype(float)
    model = quality.fit(x, y)
    z = np.full(len(y), model.intercept)
    for rule, w in model.rules:
        z += w * np.all([(x[:, quality.STATISTICS.index(n)] > t) == above for n, above, t in rule], axis=0)
    found = {r["doc_id"]: r["score"] for r in quality.classify(docs, model).collect()}
    assert np.allclose([found[k] for k, _ in texts], 1 / (1 + np.exp(-z)))
    assert np.mean((z > 0) == y) > 0.97


def test_swapping_identities_hardly_moves_the_score(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(1200):
        bad = k % 4 == 0
        group = "muslims" if bad and rng.random() < 0.8 or rng.random() < 0.05 else "christians"
        rows.append((k, f"the {group} w{rng.integers(50)} met {'idiot' if bad and rng.random() < 0.7 else 'people'}.", int(bad)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int")
    move = {}
    for weight in (0.0, 20.0):
        w = dict(toxicity.fit(sample, swap_weight=weight).weights)
        move[weight] = abs(sum(w.get(f, 0) for f in toxicity.features("muslims")) - sum(w.get(f, 0) for f in toxicity.features("christians")))
        assert w["idiot"] + w.get("idio-", 0) > 1
    assert move[0.0] > 1 and move[20.0] < move[0.0] / 4
    away = {"muslims", "musl-", "musli-", "muslim-"}
    assert list(toxicity.swapped("Muslims came. Nobody else.")) == [(away, {"christians", "chri-", "chris-", "christ-", "christi-"})]
    assert list(toxicity.swapped("Muslim muslims. . ", plant=True))[0][0] >= away - {"musl-", "musli-", "muslim-"}


def test_every_sentence_of_labelled_texts_has_a_counterfactual(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fits = {w: toxicity.train(docs, labels, fold("doc_id", 4) != 2, swap_weight=w) for w in (0.0, 1.0)}
    known = {r["doc_id"] for r in labels.where("toxic is not null").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    texts = [r["text"].lower() for r in docs.collect() if r["doc_id"] in known and r["text"]]
    assert fits[1.0].swaps == sum(1 for t in texts for part in re.split(r"[.!?\n]", t) if toxicity.words_of(part))
    assert fits[0.0].change > 0.1 and fits[1.0].change < fits[0.0].change / 100


def test_counterfactuals_are_counted_over_whole_texts(spark):
    text = "the women met. " * 300 + "old men came."
    at = {f: k for k, f in enumerate(("women", "men", "old", "young", "wome-", "youn-"))}
    found = toxicity.counterfactuals(spark.createDataFrame([(text, 1), (None, 0), ("", 0)], "text string, y int"), at, plant=False)
    assert {(tuple(r["gone"]), tuple(r["come"]), r["n"]) for r in found.collect()} == {((0, 4), (1,), 300), ((1, 2), (0, 3, 4, 5), 1)}


def test_scores_equal_a_plain_rescoring(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "idiot " + "z" * 500)], "doc_id long, text string"), allowMissingColumns=True)
    model = catalog.toxicity_model(spark, "/root/testdata/sf0.01")
    weights, edges = dict(model.weights), toxicity._EDGES

    def score(text):
        active = set()
        for word in (text or "").lower().split():
            bare = word.strip(edges)
            active |= {bare} | {bare[:k] + "-" for k in (4, 5, 6, 7) if len(bare) > k}
        return 1 / (1 + np.exp(-model.intercept - sum(w for f, w in weights.items() if f in active)))

    found = toxicity.classify(docs, model).select("doc_id", "score").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(found) == docs.count() and weights
    assert all(abs(r["score"] - score(r["text"])) < 1e-9 for r in found)


def test_quality_statistics_by_hand(spark):
    texts = ["", "A b! 12\n\nA b! 12", "the the cat. the", "é ÉÉ#$ x?\t", "\n\n", "word\n" * 3000]
    of = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "symbols": "#$%&*+/<=>@\\^_`|~{}[]", "marks": "!?", "digits": "0123456789", "spaces": " \t\n\r\x0b\x0c", "stops": ".,;:'\"()-"}
    found = quality.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    for k, text in enumerate(texts):
        raw, words, lines = text.encode(), text.split(), text.split("\n")
        size, n = len(raw), len(words)
        shares = [sum(c in chars for c in text) / max(1, size) for chars in of.values()] + [sum(b > 127 for b in raw) / max(1, size)]
        more = [0.0] * 5
        if n:
            more = [min(64, sum(len(w.encode()) for w in words) / n), min(4096, n / len(lines)), sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, 1 - len(set(lines)) / len(lines)]
        assert np.allclose(found.loc[k].to_numpy(), [np.log1p(size), *shares, *more]), text


@pytest.mark.parametrize("swap_weight", [0.0, 0.5])
def test_lasso_is_at_its_optimum(swap_weight):
    """Subgradient conditions of the convex loss that lasso_logistic() states."""
    from strideline.llm.linear import lasso_logistic, sigmoid

    rng = np.random.default_rng(2)
    x = (rng.random((300, 25)) < rng.uniform(0.05, 0.6, 25)).astype(float)
    y = (rng.random(300) < sigmoid(x @ np.where(np.arange(25) < 4, 2.0, 0.0) - 1.5)).astype(float)
    rows, cols = np.nonzero(x)
    change = rng.integers(-1, 2, (40, 25)) * (rng.random((40, 25)) < 0.1)
    s_rows, s_cols = np.nonzero(change)
    times = rng.integers(1, 4, 40).astype(float)
    swaps = (s_rows, s_cols, change[s_rows, s_cols].astype(float), times)
    l1, m = 0.01, times.sum()
    b, w = lasso_logistic(rows, cols, 300, 25, y, l1=l1, swaps=swaps, swap_weight=swap_weight, steps=6000)
    error = sigmoid(x @ w + b) - y
    slope = x.T @ error / 300 + 2 * swap_weight / m * change.T @ (times * (change @ w))
    share = x.mean(axis=0)
    bend = np.maximum(share * (1 - share), 1 / 300) + (8 * swap_weight * np.bincount(s_cols, times[s_rows], 25) / m if swap_weight else 0)
    bound = l1 * np.sqrt(bend)
    assert abs(error.mean()) < 1e-6 and 0 < (w != 0).sum() < 25
    assert np.abs(slope + np.sign(w) * bound)[w != 0].max() < 1e-6
    assert (np.abs(slope)[w == 0] <= bound[w == 0] + 1e-6).all()
