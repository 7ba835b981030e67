"""A quality classifier as a sparse rule ensemble.

Whole texts become a few statistics, counted on the bytes of Arrow batches. Boosted shallow trees over the statistics of
a bounded labelled sample give conjunctive rules (every path from a root), a lasso logistic fit keeps few of them, and
those are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import map_texts, release
from strideline.llm.linear import fold, labelled_sample, lasso_logistic, sigmoid

#: Labelled rows that a fit uses at most.
SAMPLE = 20_000
STATISTICS = ("log_bytes", "upper", "symbols", "shouts", "digits", "spaces", "stops", "wide", "word_bytes", "line_words", "repeats", "distinct", "same_lines")
_CLASS = np.full(256, 0, np.uint8)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*+/<=>@\\^_`|~{}[]", b"!?", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()-"), 1):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 7


def _describe(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text; shares of an empty text are 0."""
    sizes = np.array([len(t) for t in texts])
    counts = np.zeros((len(texts), 8))
    some = np.flatnonzero(sizes)
    if len(some):
        kinds = _CLASS[np.frombuffer(b"".join(texts), np.uint8)]
        starts = (np.cumsum(sizes) - sizes)[some]
        for k in range(1, 8):
            counts[some, k] = np.add.reduceat(kinds == k, starts, dtype=np.int64)
    more = np.zeros((len(texts), 6))
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split(b"\n")
        n = len(words)
        if n:
            more[i] = (sum(map(len, words)) / n, n / len(lines), sum(map(eq, words, words[1:])) / n, len(set(words)) / n, 1 - len(set(lines)) / len(lines), n)
    share = counts[:, 1:] / np.maximum(1, sizes)[:, None]
    return np.column_stack((np.log1p(sizes), share, more[:, :5]))


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and a double for each of STATISTICS, over whole texts; null counts as empty."""
    names = [*keep, *STATISTICS]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{s} double" for s in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                found = _describe([t or b"" for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(c) for c in found.T)], names=names)

    return map_texts(docs.select(*keep, F.col(text).cast("binary").alias("_text")), run, schema)


#: A rule: conditions (statistic, is_above, threshold) that all hold.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            held = F.lit(True)
            for name, above, t in rule:
                held = held & ((F.col(name) > t) if above else (F.col(name) <= t))
            total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(bins: np.ndarray, slope: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, value: np.ndarray, least: int) -> None:
    """Grows a regression tree on binned statistics; every node's path goes to out, leaf means to value."""
    best, cut = 1e-9, None
    if depth and len(rows) >= 2 * least:
        g = slope[rows]
        for f in range(bins.shape[1]):
            n = np.bincount(bins[rows, f], minlength=64)
            s = np.bincount(bins[rows, f], g, minlength=64)
            nl, sl = n.cumsum()[:-1], s.cumsum()[:-1]
            nr, sr = len(rows) - nl, s.sum() - sl
            gain = np.where((nl >= least) & (nr >= least), sl**2 / np.maximum(nl, 1) + sr**2 / np.maximum(nr, 1) - s.sum() ** 2 / len(rows), 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, cut = gain[k], (f, k)
    if cut is None:
        value[rows] = slope[rows].mean()
        return
    f, k = cut
    low = bins[rows, f] <= k
    for some, above in ((rows[low], False), (rows[~low], True)):
        here = (*path, (f, above, k))
        out.append(here)
        _tree(bins, slope, some, depth - 1, here, out, value, least)


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, rate: float = 0.3, l1: float = 5e-4, seed: int = 7) -> RuleEnsemble:
    """Rules of boosted trees over statistics x (rows by STATISTICS), weighted by a lasso logistic fit to y."""
    n = len(y)
    if not n or y.min() == y.max():
        return RuleEnsemble(lasso_logistic(np.zeros(0, int), np.zeros(0, int), n, 0, y, l1=l1)[0], ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 64)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    rng, total, paths = np.random.default_rng(seed), np.full(n, np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        slope, value = y - sigmoid(total), np.zeros(n)
        some = np.sort(rng.choice(n, max(1, n // 2), replace=False))
        found: list = []
        _tree(bins, slope, some, depth, (), found, value, max(5, n // 500))
        paths += found
        gain = np.zeros(n)  # every row falls into one leaf: the deepest path that holds
        for p in found:
            held = np.all([(bins[:, f] > k) if above else (bins[:, f] <= k) for f, above, k in p], axis=0)
            inside = np.intersect1d(np.flatnonzero(held), some)
            if len(inside):
                gain[held] = value[inside].mean()
        total = total + rate * 4 * gain
    rules = sorted({_tidy(p) for p in paths})
    ones = [np.flatnonzero(np.all([(bins[:, f] > k) if above else (bins[:, f] <= k) for f, above, k in r], axis=0)) for r in rules]
    cols = np.repeat(np.arange(len(rules)), np.array([len(o) for o in ones], int))
    b, w = lasso_logistic(np.concatenate([np.zeros(0, int), *ones]), cols, n, len(rules), y, l1=l1)
    named = lambda r: tuple((STATISTICS[f], above, float(edges[f][k])) for f, above, k in r)
    return RuleEnsemble(b, tuple((named(r), float(v)) for r, v in zip(rules, w, strict=True) if v))


def _tidy(path: tuple) -> tuple:
    """A path with one condition for each statistic and side: the tightest."""
    tight: dict = {}
    for f, above, k in path:
        tight[f, above] = max(k, tight.get((f, above), k)) if above else min(k, tight.get((f, above), k))
    return tuple(sorted((f, above, k) for (f, above), k in tight.items()))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", *, sample: int = SAMPLE) -> RuleEnsemble:
    """A rule ensemble from at most sample labelled documents of docs; usable is a condition on labels' rows."""
    rows = statistics(labelled_sample(docs, labels, label, usable, sample), keep=("y",)).toPandas()
    return fit(rows[list(STATISTICS)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def classify(docs: DataFrame, model: RuleEnsemble, doc_id: str = "doc_id", text: str = "text", *, threshold: float = 0.3, parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null texts count as empty and are scored like others; a null id is not held out; repeated rows are scored each;
    other columns are not read; no rows give none. A model without labels to learn from scores 0.5 throughout.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = statistics(named).select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleEnsemble, text: str = "text", *, threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose text scores under threshold; columns stay as they are."""
    numbered = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in numbered.items()])
    scored = statistics(plain, numbered[text], keep=tuple(numbered.values())).where(model.score() >= threshold)
    return scored.select(*[F.col(n).alias(c) for c, n in numbered.items()])
