"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints of whole texts are taken in Arrow batches. Equal fingerprints collapse to one row each (a partial
aggregation, so a group of copies of any size costs one row per task). The distinct fingerprints are sorted into tiles
by the population counts of their sections; the sum of the sections' count differences bounds the Hamming distance
from below, so a pair of tiles whose counts differ by more than the radius cannot hold a link and is skipped, and so
is, inside a pair, every run of rows. What remains is compared exactly with exclusive-or and bit counts in numpy. A
task returns a spanning forest of the links it finds, never all pairs of a group, and connected_components() joins the
forests.

Bounded by construction: the tile map has one row per tuple of section counts (17^4 at most for four sections of 64
bits), a tile about max(4096, 8 * sqrt(n)) fingerprints, and a task holds two tiles. The comparisons grow with the
square of the number of distinct fingerprints (times the share of tile pairs that the counts cannot rule out): that is
the method's cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.common import cores, map_texts, materialize, release
from strideline.llm.components import connected_components

ROWS_PER_TILE = 4096
#: 64-bit words of a fingerprint in which all pairs are compared.
FIRST = 4


def _second(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from each hash (the splitmix64 finaliser)."""
    z = h + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, highest bit first. 255 rows at a time are summed in bytes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    total = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def shingles(text: bytes | None, words: int) -> list[bytes]:
    """A text's runs of words, in order; one of all words if there are fewer, none without words."""
    found = (text or b"").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not found:
        return []
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[-n:]
    return [joined[a:b] for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)]


def fingerprint(text: bytes | None, words: int, bits: int = 64, seed: int = 42, unique: bool = False) -> bytes:
    """A text's SimHash as big-endian bytes; zero without words. A bit is 1 if it is set in over half of the shingles' hashes, repeats included, or with unique each different shingle counted once."""
    found = shingles(text, words)
    if not found:
        return bytes(bits // 8)
    if unique:
        found = list(set(found))
    n = len(found)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(seed)), np.uint64, n)
    parts = [hashes]
    while len(parts) < bits // 64:
        parts.append(_second(parts[-1]))
    return b"".join(np.packbits(2 * _ones(h) > n).tobytes() for h in parts)


def fingerprints(docs: DataFrame, text: str = "text", *, words: int = 5, bits: int = 64, seed: int = 42, keep: tuple[str, ...] = ("doc_id",), unique: bool = False) -> DataFrame:
    """The columns of keep and fingerprint (lowercase hex; with unique, of each different shingle once, and an empty string for wordless texts). Null text counts as empty; other columns are not read."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = (t.as_py() for t in batch.column(len(keep)))
            found = ["" if unique and not (t or b"").split() else fingerprint(t, words, bits, seed, unique).hex() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string())], names=schema.names)

    return map_texts(docs.select(*keep, F.col(text).cast("binary").alias("_text")), run, schema)


def _sections(values: np.ndarray, sections: int) -> np.ndarray:
    """Population counts of equal sections of each fingerprint (rows of 64-bit words)."""
    raw = np.bitwise_count(values.astype(">u8").view(np.uint8).reshape(len(values), -1))
    return raw.reshape(len(values), sections, -1).sum(axis=2, dtype=np.int16)


def _gap(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """The least distance that section counts between lo and hi allow to others."""
    return np.maximum(0, np.maximum(other_lo - hi, lo - other_hi)).sum(axis=-1)


def _within(rows: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows and others at radius or fewer differing bits. Of fingerprints longer than FIRST words, all pairs are compared in their first words, and only what these leave within the radius is compared whole."""
    width = rows.shape[1]
    apart = np.bitwise_count(rows[:, None, 0] ^ others[None, :, 0])
    if min(width, FIRST) > 3:  # counts up to 256
        apart = apart.astype(np.uint16)
    for w in range(1, min(width, FIRST)):
        apart += np.bitwise_count(rows[:, None, w] ^ others[None, :, w])
    i, j = np.nonzero(apart <= radius)
    if width <= FIRST:
        return i, j
    whole = apart[i, j].astype(np.int64)
    for w in range(FIRST, width):
        whole += np.bitwise_count(rows[i, w] ^ others[j, w])
    near = whole <= radius
    return i[near], j[near]


def _forest(left: np.ndarray, right: np.ndarray, same: bool, radius: int, sections: int, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (row, its root), of the links between two tiles; the right rows are numbered after the left ones."""
    n, off = len(left) + (0 if same else len(right)), 0 if same else len(left)
    counts, others = _sections(left, sections), _sections(right, sections)
    root = np.arange(n)
    for at in range(0, len(left), step):
        rows, c = left[at : at + step], counts[at : at + step]
        near = np.flatnonzero(_gap(c.min(axis=0), c.max(axis=0), others, others) <= radius)
        if same:
            near = near[near > at]
        if not len(near):
            continue
        i, j = _within(rows, right[near], radius)
        if not len(i):
            continue
        x, y = root[i + at], root[near[j] + off]
        new = np.unique(np.minimum(x, y)[x != y] * n + np.maximum(x, y)[x != y])
        if not len(new):
            continue
        move = {}

        def find(k: int) -> int:
            while (up := move.get(k, k)) != k:
                move[k] = k = move.get(up, up)
            return k

        for k in new.tolist():
            p, q = find(k // n), find(k % n)
            if p != q:
                move[max(p, q)] = min(p, q)
        table = np.arange(n)
        for k in list(move):
            table[k] = find(k)
        root = table[root]
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def links(distinct: DataFrame, *, bits: int, radius: int, column: str = "fingerprint") -> DataFrame:
    """a, b: fingerprints whose links span every component of the graph that joins fingerprints at radius or fewer differing bits.

    distinct has each fingerprint once. An empty or one-row table gives no rows.
    """
    spark = distinct.sparkSession
    sections = 4 if radius <= bits // 8 else 1  # a wide radius is never ruled out by the sections
    size = bits // 4 // sections
    count = lambda k: F.bit_count(F.conv(F.substring(column, k * size + 1, size), 16, 10).cast("decimal(20)").cast("bigint")) if size <= 8 else sum(F.bit_count(F.conv(F.substring(column, 8 * j + 1, 8), 16, 10).cast("bigint")) for j in range(bits // 32))
    keyed = distinct.select(column, F.unhex(column).alias("fp"), F.array(*[count(k).cast("int") for k in range(sections)]).alias("key"))
    groups = sorted((tuple(r["key"]), r["n"]) for r in keyed.groupBy("key").agg(F.count("*").alias("n")).collect())  # at most (bits / sections + 1) ^ sections
    n = sum(g[1] for g in groups)
    most = max(ROWS_PER_TILE, int(8 * math.sqrt(n)))
    tiles, fill, at, boxes = [], 0, 0, []
    for key, rows in groups:
        pieces = -(-rows // most)
        if fill and fill + rows > most:
            at, fill = at + 1, 0
        tiles.append((list(key), at, pieces))
        for p in range(at, at + pieces):
            if len(boxes) <= p:
                boxes.append([list(key), list(key)])
            boxes[p] = [list(map(min, boxes[p][0], key)), list(map(max, boxes[p][1], key))]
        at, fill = (at + pieces, 0) if pieces > 1 else (at, fill + rows)
    lo, hi = (np.array([b[k] for b in boxes], np.int32).reshape(-1, sections) for k in (0, 1))

    tile_map = spark.createDataFrame(tiles, "key array<int>, first int, pieces int")
    tiled = keyed.join(F.broadcast(tile_map), "key").select((F.col("first") + F.pmod(F.xxhash64(column), F.col("pieces"))).cast("int").alias("tile"), "fp", "key")

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("order")
        return pa.table({"tile": [key[0].as_py()], "block": [b"".join(rows.column("fp").to_pylist())]}, schema=pa.schema([("tile", pa.int32()), ("block", pa.binary())]))

    ordered = tiled.withColumn("order", F.concat_ws(",", F.transform("key", lambda k: F.lpad(k.cast("string"), 4, "0")))).drop("key")
    blocks, _ = materialize(ordered.groupBy("tile").applyInArrow(block, "tile int, block binary"), "tiles")

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each tile once for every tile pair that it is in: as the pair's first or its second."""
        for batch in batches:
            for t, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                near = np.flatnonzero(_gap(lo[t], hi[t], lo, hi) <= radius)
                for some in np.array_split(near, -(-len(near) // 64)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(some, t), pa.int32()), pa.array(np.maximum(some, t), pa.int32()), pa.array([t] * len(some), pa.int32()), pa.array([data.as_py()] * len(some), pa.binary())], names=["a", "b", "tile", "block"])

    tasks = max(4 * cores(spark), len(boxes) ** 2 // 64)  # in proportion to the tile pairs
    dealt = map_texts(blocks, partners, "a int, b int, tile int, block binary").repartition(tasks, "a", "b")
    first, second = dealt.where("tile = a"), dealt.where("tile = b")
    pairs = first.select("a", "b", F.col("block").alias("left")).join(second.select("a", "b", F.col("block").alias("right")), ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = bits // 64
        hexes = lambda found: pa.array([x.tobytes().hex() for x in found.astype(">u8")], pa.string())
        for batch in batches:
            for a, b, left, right in zip(*(batch.column(k) for k in range(4)), strict=True):
                one, two = (np.frombuffer(x.as_py(), ">u8").astype(np.uint64).reshape(-1, width) for x in (left, right))
                same = a.as_py() == b.as_py()
                rows, roots = _forest(one, two, same, radius, sections)
                names = one if same else np.concatenate((one, two))
                yield pa.RecordBatch.from_arrays([hexes(names[rows]), hexes(names[roots])], names=["a", "b"])

    return map_texts(pairs, compare, "a string, b string")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 5, bits: int = 64, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs.

    Documents are linked when their fingerprints differ in radius bits or fewer; component_id is the least id that a
    document reaches over links, itself included. Null and wordless texts have fingerprint zero and are linked like any
    other; a null id takes its component's id and is never one (a component of null ids only has null); repeated rows
    each give a row; other columns are ignored; no rows give none.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_body"))
    return _grouped(named, words, bits, radius, seed).select("doc_id", "fingerprint", "component_id")


def _grouped(named: DataFrame, words: int, bits: int, radius: int, seed: int, unique: bool = False) -> DataFrame:
    """fingerprint, component and component_id beside the columns of named but _body. With unique, wordless texts are a group of their own."""
    keep = tuple(c for c in named.columns if c != "_body")
    prints, _ = materialize(fingerprints(named, "_body", words=words, bits=bits, seed=seed, keep=keep, unique=unique), "prints")
    each, _ = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = connected_components(links(each.where("fingerprint <> ''").select("fingerprint"), bits=bits, radius=radius))
    members = each.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component"))
    least_id, _ = materialize(members.groupBy("component").agg(F.min("first_id").alias("component_id")), "components")
    members, _ = materialize(members.join(least_id, "component").select("fingerprint", "component", "component_id"), "members")
    return prints.join(members, "fingerprint")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 5, bits: int = 512, radius: int = 102, seed: int = 42) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the least id.

    Texts are linked when the fingerprints of their sets of five-word shingles are 0.8 similar or more: at most radius of
    bits differ (1 - 102 / 512 = 0.8), which estimates a cosine of the sets of 0.81. Each different shingle counts once,
    else texts that repeat one phrase would be alike by that phrase alone. Null and wordless texts are one group, which
    no other text joins; texts of equal fingerprints count as one. A null id is chosen only where its group has no other;
    rows that repeat both id and text are cut to one. Columns and their names stay as they are.
    """
    body = F.xxhash64(F.col(text))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_body"), body.alias("body_key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "body_key"))
    chosen = _grouped(named, words, bits, radius, seed, unique=True).groupBy("component").agg(first.alias("first"))
    chosen, _ = materialize(chosen.select(F.col("first.doc_id").alias("_kept"), F.col("first.body_key").alias("_key")), "kept")
    same = lambda d, k: d[doc_id].eqNullSafe(k["_kept"]) & (F.xxhash64(d[text]) == k["_key"])
    alone = docs.join(chosen, same(docs, chosen), "left_semi")
    twice = _repeated(docs.select(F.col(doc_id).alias("_kept"), body.alias("_key")))
    if twice.isEmpty():
        return alone
    again = alone.join(twice, same(alone, twice), "left_semi")
    return alone.join(twice, same(alone, twice), "left_anti").unionByName(again.dropDuplicates([doc_id, text]))


def _repeated(keys: DataFrame) -> DataFrame:
    """The id and text keys that more than one row has."""
    return materialize(keys.groupBy("_kept", "_key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")[0]
