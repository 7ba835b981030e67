"""Exact top-k inner-product search by a three-phase uniform threshold.

The vectors' components are dealt to slices, and a slice's partial inner products are one score list. Phase one takes
the best k entries of every local list (block by block), resolves them and gathers each query's k best sums so far: the
least of these is a cutoff that no true result falls below. Phase two hands the cutoffs
to all blocks: a sum reaches the cutoff only if some slice reaches the cutoff's uniform share, and only if known and bounded parts together reach it. Phase three adds up
what is left and keeps the sums at the cutoff or above; a handful of rows per query is ranked in the end.

Queries and rows meet in a grid of blocks of bounded size. The blocks of rows stay where they are dealt once; a copy of
each block of queries, an eighth as many rows, goes to each of them. Nothing is broadcast but the numbers of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.llm.common import cores, map_texts, materialize

ROWS_PER_BLOCK, QUERIES_PER_BLOCK, SLICES = 8192, 1024, 4
_BLOCK = "block int, ids binary, keys binary, cells binary, wide boolean, width int, cuts binary"


def integral(vectors: DataFrame, vec_id: str, embedding: str, scale: int = 1024) -> DataFrame:
    """id, cells: floor(scale * x) of each component as a double; rows with a null id, a null vector or a null or non-finite component are left out."""
    whole = F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cells = F.transform(embedding, lambda x: _floor(x.cast("double") * scale))
    return vectors.where(F.col(vec_id).isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), cells.alias("cells"))


def _floor(x: Column) -> Column:
    """floor() as a double, also beyond the range of long."""
    return F.when(F.abs(x) < 2.0**53, F.floor(F.when(F.abs(x) < 2.0**53, x).otherwise(0.0)).cast("double")).otherwise(x)


def _blocks(rows: DataFrame, count: int, cut: Column | None = None) -> DataFrame:
    """Dense blocks of rows (id, key, cells): ids and keys as 64-bit integers, cells as a matrix padded with zeros."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        cells = group.column("cells").combine_chunks()
        sizes = np.diff(cells.offsets.to_numpy())
        matrix = np.zeros((len(sizes), max(1, sizes.max(initial=0))))
        matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = cells.flatten().to_numpy()
        wide = bool(np.abs(matrix).max(initial=0) >= 2**31)
        cuts = group.column("cut").to_numpy().astype(np.float64)  # null: NaN
        line = [key[0].as_py(), group.column("id").to_numpy().tobytes(), group.column("key").to_numpy().tobytes(), matrix.astype("<f8" if wide else "<i4").tobytes(), wide, matrix.shape[1], cuts.tobytes()]
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.int32(), pa.binary())
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(line, types, strict=True)], names=_BLOCK.replace(",", "").split(" ")[::2])

    numbered = rows.withColumn("cut", cut if cut is not None else F.lit(None).cast("double")).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.lit(count)).cast("int"))
    return numbered.groupBy("block").applyInArrow(build, _BLOCK)


def _grid(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int) -> DataFrame:
    """Every block of rows beside every block of queries, dealt by the block of rows."""
    tasks = max(cores(rows.sparkSession), n_rows)
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    left = named(queries, "q").withColumn("r_block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))).repartition(tasks, "r_block")
    return left.join(named(rows, "r").repartition(tasks, "r_block").hint("merge"), "r_block")


def _matrix(cells: bytes, wide: bool, width: int, to: int) -> np.ndarray:
    found = np.frombuffer(cells, "<f8" if wide else "<i4").reshape(-1, width).astype(np.float64)
    return np.pad(found, ((0, 0), (0, to - width)))


def _partial(q: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    """The slices' inner products, exact: in doubles where no sum reaches 2**53, else in Python's integers."""
    if np.abs(q).max(initial=0) * np.abs(r).max(initial=0) * q.shape[1] >= 2**53:
        q, r = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, r))
    parts = np.array_split(np.arange(q.shape[1]), min(SLICES, q.shape[1]))
    return [q[:, p] @ r[:, p].T for p in parts]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k and scores.dtype != object:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    order = sorted(keep.tolist(), key=lambda i: (-scores[i], ids[i])) if len(keep) <= 4 * k or scores.dtype == object else keep[np.lexsort((ids[keep], -scores[keep]))].tolist()
    return np.array(order[:k], int)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in (r for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
            width = max(row["r_width"], row["q_width"])
            q, r = (_matrix(row[f"{p}_cells"], row[f"{p}_wide"], row[f"{p}_width"], width) for p in "qr")
            ints = lambda c: np.frombuffer(row[c], np.int64)  # noqa: E731, B023
            yield ints("q_ids"), ints("q_keys"), ints("r_ids"), _partial(q, r), np.frombuffer(row["q_cuts"]), row["r_block"]


LEAST, MOST = -(2**63), 2**63 - 1


def _long(x: float | int) -> int:
    return max(LEAST, min(MOST, int(x)))


def _beyond(x: float | int) -> bytes | None:
    """What orders scores that _long() makes equal to its ends: bytes that compare as the scores do; None within."""
    x = int(x)
    if LEAST < x < MOST:
        return None
    size = (abs(x).bit_length() + 7) // 8
    body = size.to_bytes(4, "big") + abs(x).to_bytes(size, "big")
    return body if x > 0 else bytes(255 - b for b in body)


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", *, k: int = 10, scale: int = 1024, rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for every query row, the k rows with the highest inner products of floor(scale * x), ties to the smaller vec_id; all rows but those with the query's own id are candidates.

    Fewer than k candidates are all returned. Vectors of different lengths are compared as if the shorter went on in
    zeros. Rows with a null id or vector, or a null, NaN or infinite component, take no part. A repeated row is a
    candidate each time; a query row repeated with the same vector is answered once. Scores beyond 64 bits are ranked
    as they are and returned as the nearest 64-bit integer. An empty table gives no rows; other columns are ignored.
    """
    rows = integral(vectors, vec_id, embedding, scale).withColumn("key", F.monotonically_increasing_id())
    asked = integral(vectors.where(is_query), vec_id, embedding, scale).distinct().withColumn("key", F.monotonically_increasing_id())
    asked, _ = materialize(asked, "queries")
    n_rows, n_queries = -(-rows.count() // rows_per_block) or 1, -(-asked.count() // queries_per_block) or 1
    blocks, _ = materialize(_blocks(rows, n_rows), "vectors")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q_keys, r_ids, parts, _, block in _pairs(batches):
            out = []
            for i in range(len(q_ids)):
                own = r_ids == q_ids[i]
                local = set()
                for p in parts:
                    line = p[i] if p.dtype == object else np.where(own, -np.inf, p[i])
                    local.update(_best(line, r_ids, k).tolist())
                sums = sorted((_long(sum(p[i, j] for p in parts)) for j in local if not own[j]), reverse=True)
                out.append(sums[:k])
            yield pa.RecordBatch.from_arrays([pa.array(q_keys), pa.array([block] * len(out), pa.int32()), pa.array(out, pa.list_(pa.int64()))], names=["key", "block", "scores"])

    lists = map_texts(_grid(blocks, _blocks(asked, n_queries), n_rows, n_queries), first, "key long, block int, scores array<long>")
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), 1, k).alias("scores")
    lists = lists.groupBy("key", F.pmod("block", F.lit(int(n_rows**0.5) + 1)).alias("lane")).agg(merged).groupBy("key").agg(merged)
    last = F.col("scores")[k - 1]
    cut = F.when((F.size("scores") == k) & (last > LEAST), last.cast("double"))  # the least long may stand for less
    cutoffs, _ = materialize(lists.select("key", cut.alias("cutoff")), "cutoffs")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q_keys, r_ids, parts, cuts, _ in _pairs(batches):
            lines: list[tuple] = []
            for i in range(len(q_ids)):
                low = -np.inf if np.isnan(cuts[i]) else cuts[i] - (abs(cuts[i]) >= 2**53) * abs(cuts[i]) * 1e-15
                share = low / len(parts)
                if np.isinf(low):
                    some = np.arange(len(r_ids))
                else:
                    bound, some = 0, np.zeros(len(r_ids), bool)
                    for p in parts:
                        bound = bound + np.maximum(p[i], share)
                        some |= (p[i] >= share).astype(bool)
                    some = np.flatnonzero(some & (bound >= low - 1).astype(bool))
                some = some[r_ids[some] != q_ids[i]]
                if len(some):
                    sums = sum(p[i, some] for p in parts)
                    enough = np.flatnonzero((sums >= low).astype(bool))
                    some, sums = some[enough], sums[enough]
                    lines += [(q_ids[i], q_keys[i], r_ids[some[j]], _long(sums[j]), _beyond(sums[j])) for j in _best(sums, r_ids[some], k)]
            yield pa.RecordBatch.from_arrays([*(pa.array([int(x[c]) for x in lines], pa.int64()) for c in range(4)), pa.array([x[4] for x in lines], pa.binary())], names=["query_id", "key", "vec_id", "score", "beyond"])

    again = _blocks(asked.join(cutoffs, "key", "left"), n_queries, F.col("cutoff"))
    found = map_texts(_grid(blocks, again, n_rows, n_queries), rest, "query_id long, key long, vec_id long, score long, beyond binary")
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
