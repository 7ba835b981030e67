"""Extendible hashing of documents into shards under a byte limit, in DataFrame operations only.

A document's key hashes to 60 bits. A shard is a bit prefix, and the directory says how long it is where: the shortest
prefix whose documents fit the limit. Bytes are first summed in cells a few bits finer than an even spread would need
(a partial aggregation), then over every shorter prefix; only cells that still exceed the limit are split on further
bits. A key repeated on so many rows that they alone exceed the limit is told apart by row.

The directory has a few rows for each shard; it is joined, never collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import materialize

BITS = 60


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text; a null key hashes like an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _cells(rows: DataFrame, depth: int) -> DataFrame:
    return rows.groupBy(F.shiftright("hash", BITS - depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))


def _directory(cells: DataFrame, depth: int, least: int, limit: int) -> DataFrame:
    """cell, depth: each cell's shortest prefix of least to depth bits that fits; null where not even the cell does."""
    up = cells.withColumn("d", F.explode(F.sequence(F.lit(least), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - d)"))
    fits = up.groupBy("d", "prefix").agg(F.sum("bytes").alias("total"), F.sum("n").alias("rows")).where(f"total <= {limit} or rows = 1")
    found = up.join(fits, ["d", "prefix"]).groupBy("cell").agg(F.min("d").alias("depth"))
    return materialize(cells.select("cell").join(found, "cell", "left"), "directory")[0]


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, limit: int = 128 << 20) -> DataFrame:
    """doc_id, n_bytes, shard: each document's UTF-8 bytes and its shard, a string of bits ('' while all fit in one).

    Every shard's bytes are at most limit, unless it is a single document larger than that. Null texts have no bytes;
    null ids share one key; rows that repeat an id go together until they alone exceed the limit. No rows give none;
    other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), key_hash(F.col(doc_id)).alias("hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    rows, _ = materialize(rows, "keys")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth, least, done = min(BITS, math.ceil(math.log2(max(1, total / limit))) + 4), 0, []
    while True:
        cells, _ = materialize(_cells(rows, depth), "cells")
        directory = _directory(cells, depth, least, limit)
        placed = rows.join(directory, F.shiftright(rows["hash"], BITS - depth) == directory["cell"])
        over = directory.where("depth is null")
        if over.isEmpty():
            done.append(placed.drop("cell"))
            break
        done.append(placed.where("depth is not null").drop("cell"))
        rows, _ = materialize(placed.where("depth is null").drop("cell", "depth"), "oversized")
        hot = rows.groupBy("hash").agg(F.sum("bytes").alias("total"), F.count("*").alias("n")).where(f"total > {limit} and n > 1")
        hot, _ = materialize(hot.select("hash", F.lit(True).alias("hot")), "repeated")
        if not hot.isEmpty():  # the bits that the cell has stay, the rest come from the row
            keep, rest = depth, BITS - depth
            again = F.shiftleft(F.shiftright("hash", rest), rest).bitwiseOR(F.shiftright(key_hash(F.col("row")), keep))
            rows, _ = materialize(rows.join(hot, "hash", "left").withColumn("hash", F.when(F.col("hot"), again).otherwise(F.col("hash"))).drop("hot"), "salted")
        if depth == BITS:
            raise ValueError("documents with equal hashes exceed the limit")
        depth, least = min(BITS, depth + 6), depth + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(F.expr(f"shiftright(hash, {BITS} - depth)")), F.col("depth"), F.lit("0")))
    return out.select("doc_id", F.col("bytes").alias("n_bytes"), bits.alias("shard"))


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", *, limit: int = 128 << 20) -> None:
    """Writes docs as Parquet, one folder for each shard; a task writes whole shards, each of which fits the limit. Rows of one id lie in one shard.

    The folders' column is shard, with underscores before it where docs have a column of that name; all columns of docs
    are written as they are.
    """
    folder = "shard"
    while folder.lower() in (c.lower() for c in docs.columns):
        folder = f"_{folder}"
    number = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in number.items()])
    key = number[doc_id]
    homes = shard(plain, key, number[text], limit=limit).select(F.col("doc_id").alias("_id"), F.concat(F.lit("b"), "shard").alias("_home")).distinct()
    joined = plain.join(homes, plain[key].eqNullSafe(homes["_id"])).repartition("_home")
    joined.select(*[F.col(n).alias(c) for c, n in number.items()], F.col("_home").alias(folder)).write.partitionBy(folder).parquet(path)
