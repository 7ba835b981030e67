"""Vector code compression: one small codebook for each part of the vectors, fitted on distinct parts with weights.

Components become integers and vectors are cut into equal parts. Equal parts at a place are one row with a weight (a
partial aggregation, so a part that a third of all vectors share costs one row for each task), and Lloyd's rounds run
over these rows alone: a task assigns its rows and returns one sum for each place and entry. Codes and errors of
distinct parts are joined back to the vectors by place and part; both sides of that join are freshly exchanged, so that
adaptive execution can split a hot part, and so are those of the join with the labels' totals.

The driver holds the codebooks, entries times width integers, and nothing else. All arithmetic is in integers, so results
depend neither on the order of rows nor on their partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import materialize, release

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are under this in magnitude, so that squared distances and their sums stay far inside 64 bits.
MOST = 1 << 24
#: Parts that are held against the codebook at a time.
AT_ONCE = 16_384


def _integral(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, cells of the rows whose vector is whole."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    within = lambda x: F.when(F.abs(x) < MOST, x).otherwise(F.raise_error(F.lit(f"a component is out of range: {scale} times it has to be under {MOST}")))
    cells = F.transform(embedding, lambda x: F.floor(within(x.cast("double") * scale)).cast("int"))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), cells.alias("cells"))


def _nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry, ties to the lower index, and its squared distance."""
    exact = parts.shape[1] * (2 * max(np.abs(parts).max(initial=0), np.abs(codebook).max(initial=0))) ** 2 < 2**53
    kind = np.float64 if exact else np.int64  # products of doubles are exact under 2**53, and much faster
    p, c = parts.astype(kind), codebook.astype(kind)
    gap = (c * c).sum(axis=1) - 2 * (p @ c.T)
    best = gap.argmin(axis=1)
    return best, (gap[np.arange(len(p)), best] + (p * p).sum(axis=1)).astype(np.int64)


def _assigned(batch: pa.RecordBatch, codebooks: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Place, rows, their parts, entries and errors; batch begins with the columns place and part."""
    place = batch.column(0).to_numpy()
    part = batch.column(1).flatten().to_numpy().reshape(len(batch), -1).astype(np.int64)
    for k in np.unique(place).tolist():
        rows = np.flatnonzero(place == k)
        for at in range(0, len(rows), AT_ONCE):
            some = rows[at : at + AT_ONCE]
            yield k, some, part[some], *_nearest(part[some], codebooks[k])


def _refined(distinct: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry is the floor of its parts' weighted mean, unused ones stay."""
    places, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums, weights = np.zeros(codebooks.shape, np.int64), np.zeros((places, entries), np.int64)
        for batch in batches:
            weight = batch.column(2).to_numpy()
            for k, rows, part, entry, _ in _assigned(batch, codebooks):
                np.add.at(weights[k], entry, weight[rows])
                np.add.at(sums[k], entry, part * weight[rows, None])
        p, e = np.nonzero(weights)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(weights[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["place", "entry", "weight", "sums"])

    partial = distinct.mapInArrow(run, "place int, entry int, weight long, sums array<long>")
    whole = partial.groupBy("place", "entry").agg(F.sum("weight").alias("weight"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    new = codebooks.copy()
    for r in whole.collect():  # places times entries rows at most
        new[r["place"], r["entry"]] = [x // r["weight"] for x in r["sums"]]
    return new


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes (the nearest entry's index for each part), errors (their squared distances) for each whole vector; and the codebooks (part, entry, component).

    A component x counts as floor(scale * x). The codebooks start as the parts of the rows with the entries smallest
    ids (rows that repeat an id by their integers, null ids last) and take rounds of Lloyd's algorithm over all rows.

    Rows whose vector is null or holds a null, NaN or infinite component are left out; a component too large for MOST
    raises an error. Shorter vectors go on in zeros to the length of the longest, and all do to a multiple of parts.
    With fewer rows than entries the codebooks are as short; no rows give none. Repeated rows and null ids or labels
    each give a row; other columns are ignored.
    """
    spark = vectors.sparkSession
    kept, _ = materialize(_integral(vectors, vec_id, embedding, label, scale), "vectors")
    longest = kept.agg(F.max(F.size("cells"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    padded = F.concat("cells", F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("cells")))
    kept = kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", padded.alias("cells"))
    first = [r["cells"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "cells").limit(entries).select("cells").collect()]
    codebooks = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    schema = "vec_id {}, label {}, codes array<int>, errors array<long>".format(*(kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")))
    if not first:
        return spark.createDataFrame([], schema), codebooks

    slices = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice("cells", k * width + 1, width))
    each = kept.select("row", "vec_id", "label", F.posexplode(slices).alias("place", "part"))
    distinct, _ = materialize(each.groupBy("place", "part").agg(F.count("*").alias("weight")), "parts")
    for _ in range(rounds):
        codebooks = _refined(distinct, codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, error = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            for _, rows, _, e, d in _assigned(batch, codebooks):
                entry[rows], error[rows] = e, d
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entry), pa.array(error)], names=["place", "part", "entry", "error"])

    coded = distinct.mapInArrow(run, "place int, part array<int>, entry int, error long").hint("merge")
    back = each.join(coded, ["place", "part"]).groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("place", "entry", "error"))).alias("found"))  # parts entries a row
    return back.select("vec_id", "label", F.col("found.entry").alias("codes"), F.col("found.error").alias("errors")), codebooks


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all integers in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def summary(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", **how: int) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error (the errors' sum over equal labels, nulls together), codebooks_sha256; else as compress()."""
    coded, codebooks = compress(vectors, vec_id, embedding, label, **how)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows, _ = materialize(coded.select("vec_id", "label", code.alias("code"), F.aggregate("errors", F.lit(0).cast("long"), lambda a, x: a + x).alias("error")), "codes")
    totals = rows.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error")).hint("merge")
    return rows.join(totals, F.col("label").eqNullSafe(F.col("_of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
