"""A toxicity classifier with counterfactual regularisation.

A text's features are its distinct words and their beginnings. The features that tell labelled texts apart are chosen
by aggregation over a bounded sample, and their weights fitted by lasso logistic regression with a penalty on how much
the score moves when a labelled sentence's identity terms are swapped for others of their kind, so that naming a group
is no evidence by itself. A labelled sentence without such a term stands for itself with a neutral mention of a group put
into it, beside the same with another group of the kind: few corpora name groups often enough in labelled sentences.
All sentences of the sampled texts count; equal swaps are counted together in Spark.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import Memory, held, map_texts
from strideline.llm.linear import fold, labelled_sample, lasso_logistic

#: Labelled rows that a fit uses at most.
SAMPLE = 12_000
#: Words that a Python worker remembers at most.
REMEMBERED = 250_000
#: Terms that may stand for one another in a sentence, by kind.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("mothers", "fathers"),
    ("mujeres", "hombres"), ("femmes", "hommes"), ("frauen", "männer"), ("madres", "padres"), ("mères", "pères"), ("mütter", "väter"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("black", "white", "asian", "latino", "arab"), ("africans", "europeans", "asians", "americans", "mexicans"),
    ("africanos", "europeos", "asiáticos", "americanos"), ("africains", "européens", "asiatiques", "américains"), ("afrikaner", "europäer", "asiaten", "amerikaner"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("gais", "lesbianas", "bisexuales", "transexuales"), ("schwule", "lesben", "bisexuelle", "transsexuelle"),
    ("immigrants", "locals", "refugees", "foreigners"), ("inmigrantes", "vecinos", "refugiados", "extranjeros"), ("immigrés", "voisins", "réfugiés", "étrangers"), ("einwanderer", "nachbarn", "flüchtlinge", "ausländer"),
    ("old", "young"), ("elderly", "teenagers"), ("deaf", "blind", "disabled"), ("sordos", "ciegos"), ("sourds", "aveugles"), ("gehörlose", "blinde"),
)
_EDGES = " \t\n\r\x0b\x0c.,;:!?'\"()[]{}<>|%$#&*+-=_/\\~`@^…«»„“”‘’¡¿"
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> tuple[str, ...]:
    """A bare word and its beginnings of 4 to 7 letters, each marked as such."""
    return (word, *(f"{word[:k]}-" for k in range(4, 8) if len(word) > k))


def _bare(words: set[str]) -> set[str]:
    return {w.strip(_EDGES) for w in words}


def words_of(text: str) -> set[str]:
    """A text's distinct words in lower case, without the punctuation around them."""
    return _bare(set(text.lower().split())) - {""}


@dataclass(frozen=True)
class WordModel:
    """Weights of features; swaps is how many counterfactual pairs of sentences the fit had, change their scores' mean squared difference (before the logistic function)."""

    intercept: float
    weights: tuple[tuple[str, float], ...]
    swaps: int = 0
    change: float = 0.0


def swapped(text: str, identities: tuple[tuple[str, ...], ...] = IDENTITIES, *, plant: bool = False) -> Iterator[tuple[set[str], set[str]]]:
    """For each sentence with identity terms: the features that swapping each for the next of its kind takes away and brings.

    plant puts a term into each other sentence with words first; its kind and place there come from the sentence's CRC-32.
    """
    turn = {t: kind[(k + 1) % len(kind)] for kind in identities for k, t in enumerate(kind)}
    for sentence in _SENTENCE.findall(text.lower()):
        words = words_of(sentence)
        found = {w for w in words if w in turn}
        if not found and plant and words and identities:
            pick = zlib.crc32(sentence.encode())
            kind = identities[pick % len(identities)]
            found = {kind[pick // len(identities) % len(kind)]}
        if found:
            rest = {f for w in words - found for f in features(w)}
            old, new = ({f for w in ws for f in features(w)} | rest for ws in (found, {turn[w] for w in found}))
            yield old - new, new - old


def _choose(sample: DataFrame) -> list[str]:
    """The features of 4 texts or more whose presence differs between the two labels by at least 4 standard errors. The sample bounds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                counts: dict[str, list[int]] = {}
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for f in {f for w in words_of(text or "") for f in features(w)}:
                        counts.setdefault(f, [0, 0])[y] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["feature", "no", "yes"])

    total = sample.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in total}
    if len(n) < 2:
        return []
    counted = map_texts(sample.select("text", "y"), run, "feature string, no long, yes long").groupBy("feature").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).where("no + yes >= 4")
    rate = (F.col("no") + F.col("yes")) / F.lit(n[0] + n[1])
    z = (F.col("yes") / F.lit(n[1]) - F.col("no") / F.lit(n[0])) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) * F.lit(1 / n[0] + 1 / n[1]))
    return [r["feature"] for r in counted.where(F.abs(z) >= 4).select("feature").collect()]


def counterfactuals(sample: DataFrame, at: dict[str, int], identities: tuple[tuple[str, ...], ...] = IDENTITIES, *, plant: bool = True) -> DataFrame:
    """gone, come, n: the swaps of all sentences of a sample's texts, as sorted numbers of the features that they take away and bring (those of at), and how many sentences have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lambda fs: tuple(sorted(at[f] for f in fs if f in at))
        for batch in batches:
            found = Counter((code(a), code(b)) for text in batch.column(0).to_pylist() for a, b in swapped(text or "", identities, plant=plant))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], kind), pa.array([k[1] for k in found], kind), pa.array(list(found.values()), pa.int64())], names=["gone", "come", "n"])

    return map_texts(sample.select("text"), run, "gone array<int>, come array<int>, n long").groupBy("gone", "come").agg(F.sum("n").alias("n"))


def fit(sample: DataFrame, *, identities: tuple[tuple[str, ...], ...] = IDENTITIES, l1: float = 5e-4, swap_weight: float = 1.0, plant: bool = True) -> WordModel:
    """A model from a bounded sample (text, y); swaps are those of all its sentences, planted mentions among them unless plant is false."""
    sample = sample.select("text", "y").persist()
    try:
        chosen = sorted({*_choose(sample), *(f for kind in identities for t in kind for f in features(t))})
        at = {f: k for k, f in enumerate(chosen)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [sorted({at[f] for w in words_of(text or "") for f in features(w) if f in at}) for text in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["y", "ids"])

        rows = map_texts(sample, run, "y int, ids array<int>").collect()
        pairs = counterfactuals(sample, at, identities, plant=plant).orderBy("gone", "come").collect()
    finally:
        sample.unpersist()
    y = np.array([r["y"] for r in rows], float)
    lengths = [len(r["ids"]) for r in rows]
    cols = np.array([k for r in rows for k in r["ids"]], int)
    moves = [(i, k, s) for i, r in enumerate(pairs) for s, ks in ((-1.0, r["gone"]), (1.0, r["come"])) for k in ks]
    turned = (np.array([m[0] for m in moves], int), np.array([m[1] for m in moves], int), np.array([m[2] for m in moves], float), np.array([r["n"] for r in pairs], float))
    b, w = lasso_logistic(np.repeat(np.arange(len(rows)), lengths), cols, len(rows), len(chosen), y, l1=l1, swaps=turned, swap_weight=swap_weight)
    total = int(turned[3].sum())
    moved = np.bincount(turned[0], turned[2] * w[turned[1]], len(pairs)) if total else np.zeros(0)
    change = float((turned[3] * moved**2).sum() / total) if total else 0.0
    return WordModel(b, tuple((f, float(v)) for f, v in zip(chosen, w, strict=True) if v), total, change)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", *, sample: int = SAMPLE, **settings) -> WordModel:
    """A model from at most sample labelled documents of docs; usable is a condition on labels' rows."""
    return fit(labelled_sample(docs, labels, label, usable, sample), **settings)


class _Scorer:
    def __init__(self, model: WordModel):
        self.intercept, self.at, self.memory = model.intercept, dict(model.weights), Memory(REMEMBERED)

    def __call__(self, text: str | None) -> float:
        known, recall, at = self.memory.now, self.memory.recall, self.at
        active: set[str] = set()
        for w in set((text or "").lower().split()):
            found = known.get(w)
            if found is None:
                found = recall(w)
                if found is None:
                    found = tuple(f for f in features(w.strip(_EDGES)) if f in at)
                    if len(w) < 64:
                        known[w] = found
            if found:
                active.update(found)
        return self.intercept + sum(at[f] for f in sorted(active))


def _scorer(model: WordModel) -> _Scorer:
    return held(("toxicity", model), lambda: _Scorer(model))


def scores(docs: DataFrame, model: WordModel, text: str = "text", *, out: str = "score", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and out: the probability that the whole text is toxic. Null counts as empty."""
    names = [*keep, out]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            score.memory.turn()
            z = np.array([score(t.as_py()) for t in batch.column(len(keep))], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(1 / (1 + np.exp(-z)))], names=names)

    return map_texts(docs.select(*keep, F.col(text).alias("_text")), run, schema)


def classify(docs: DataFrame, model: WordModel, doc_id: str = "doc_id", text: str = "text", *, threshold: float = 0.3, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null texts count as empty and are scored like others; a null id is not held out; repeated rows are scored each;
    other columns are not read; no rows give none. A model without labels to learn from scores 0.5 throughout.
    """
    scored = scores(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: WordModel, text: str = "text", *, threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose text scores threshold or more; columns stay as they are."""
    numbered = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in numbered.items()])
    scored = scores(plain, model, numbered[text], out="_score", keep=tuple(numbered.values())).where(F.col("_score") < threshold)
    return scored.select(*[F.col(n).alias(c) for c, n in numbered.items()])
