"""Folders of recordings, one trajectory in each file, of any size: a bad file spoils no other.

Text files are read in ranges that end at line ends (Spark's text source), so many tasks may share a file. Each line keeps its
range's offset and its place there, which give its place in the file; a file's header goes to all its ranges, and what only
the whole file tells, what is wrong with it and how its times are written, is decided by one window over its rows. A
Parquet file is one row of Spark's binary file source and is read by one task (2 GB at most).
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts that stand for no value.
EMPTY = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None"]
# A clock time, and a number within a text.
STAMP, FIRST = r"^\s*(\d{2}):(\d{2}):(\d{2})\.(\d{3})", r"(\d+\.?\d*)"
#: What a text may be as a time, in the order of time_of().
_TIMES = ("t_number", "t_duration", "t_stamp", "t_first")


def time_candidates(values: pd.Series) -> pd.DataFrame:
    """A column of texts as numbers, durations in seconds, seconds of clock times and the first number in each; NaN where a text is none."""
    texts = values.astype("object").where(values.notna(), None)
    parts = texts.str.extract(STAMP).astype(float)
    return pd.DataFrame({
        "t_number": pd.to_numeric(texts, errors="coerce").astype(float),
        "t_duration": pd.to_timedelta(texts, errors="coerce").dt.total_seconds(),
        "t_stamp": parts[0] * 3600 + parts[1] * 60 + parts[2] + parts[3] / 1000,
        "t_first": pd.to_numeric(texts.str.extract(FIRST)[0], errors="coerce").astype(float),
    })


def time_of(seen: Column, by: Window) -> Column:
    """Seconds of a whole column of texts by the first of these that fits: all numbers; all durations; some numbers; some clock times; the first number in each. seen says which rows have a text."""
    n = F.count(F.when(seen, 1)).over(by)
    number, duration, stamp, first = (F.col(c) for c in _TIMES)
    many = lambda c: F.count(c).over(by)
    return F.when(many(number) == n, number).when(many(duration) == n, duration).when(many(number) > 0, number).when(many(stamp) > 0, stamp).otherwise(first)


def column_seconds(values: pd.Series) -> pd.Series:
    """time_of() a whole column in memory, as a Parquet file's is."""
    found, n = time_candidates(values), values.notna().sum()
    some = found.notna().sum()
    for name, fits in (("t_number", some["t_number"] == n), ("t_duration", some["t_duration"] == n), ("t_number", some["t_number"] > 0), ("t_stamp", some["t_stamp"] > 0)):
        if fits:
            return found[name]
    return found["t_first"]


def _number(column: pa.ChunkedArray | pa.Array, name: str, *, strict: bool) -> pa.Array:
    """A column as doubles; texts that are no numbers raise if strict, else they are null."""
    one = lambda a: a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        trimmed = pc.utf8_trim_whitespace(column)
        try:
            return one(pc.cast(trimmed, pa.float64()))
        except pa.ArrowInvalid:
            if strict:
                raise ValueError(f"{name} holds a text that is no number") from None
            return pa.array(pd.to_numeric(trimmed.to_pandas(), errors="coerce"), pa.float64())
    return one(pc.cast(column, pa.float64()))


def _columns(have: list[str], names: dict[str, str], positional: bool) -> dict[str, str]:
    """Each field's column; x and z are needed."""
    at = {f: c for f, c in names.items() if c in have}
    if positional:
        for f, c in zip(("x", "z", "t"), have):
            at.setdefault(f, c)
    if missing := [names.get(f, f) for f in ("x", "z") if f not in at]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return at


def _delimiter(file: str) -> str:
    return "\t" if file.lower().endswith(".tsv") else ","


def _parse(lines: list[str], file: str, names: list[str] | None = None) -> pa.Table:
    """Lines of a text file as texts; rows with fewer columns go, those with more raise."""
    wide: list = []

    def odd(row: pacsv.InvalidRow) -> str:
        if row.actual_columns > row.expected_columns:
            wide.append(row)
        return "skip"

    parse = pacsv.ParseOptions(delimiter=_delimiter(file), invalid_row_handler=odd)
    data = "\n".join(lines).encode() + b"\n"
    read = pacsv.ReadOptions(column_names=names, block_size=max(1 << 20, len(data) + 1))
    texts = pacsv.ConvertOptions(column_types={n: pa.string() for n in names or ()}, null_values=EMPTY, strings_can_be_null=True)
    table = pacsv.read_csv(io.BytesIO(data), read, parse, texts)
    if wide:
        raise ValueError("a row has more columns than the header")
    return table


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file, block (its range's offset), spot (the line's place in the range), line."""
    raw = spark.read.option("pathGlobFilter", pattern).text(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    named = raw.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, seen = None, 0  # a task reads a range whole and in order
        for batch in batches:
            files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            spots = []
            for key in zip(files, blocks, strict=True):
                range_, seen = key, seen + 1 if key == range_ else 0
                spots.append(seen)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spots, pa.int64()), batch.column(2)], names=["file", "block", "spot", "line"])

    return named.mapInArrow(number, "file string, block long, spot long, line string")


def _is_parquet(pattern_or_file: Column) -> Column:
    return F.lower(pattern_or_file).rlike(r"\.(parquet|pq)$")


def _text_rows(spark: SparkSession, path: str, pattern: str, names: dict[str, str], fields: tuple[str, ...], positional: bool, count_time: bool) -> DataFrame:
    lines = _lines(spark, path, pattern).where(~_is_parquet(F.col("file")))
    head = (F.col("block") == 0) & (F.col("spot") == 0)
    heads = lines.where(head).select(F.col("file").alias("_file"), F.col("line").alias("head"))
    # a header's own row goes along: it says what is wrong with a file that has no other
    both = lines.join(heads, F.col("file") == F.col("_file")).select("file", "block", "spot", "head", F.when(~head, F.col("line")).alias("line"), F.length(F.trim("line")).alias("size"))
    out = ["file", "block", "spot", "size", "problem", "seen", *_TIMES, *fields]
    schema = "file string, block long, spot long, size int, problem string, seen boolean, " + ", ".join(f"{c} double" for c in _TIMES) + ", " + ", ".join(f"`{f}` double" for f in fields)

    def rows(file: str, header: str, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The data lines of a file in a batch."""
        if not header.strip():
            raise ValueError("empty file")
        have = _parse([header], file).column_names
        at = _columns(have, names, positional)
        lines, place = batch.column(4).to_pylist(), range(len(batch))
        some = [k for k in place if lines[k] is not None and lines[k].strip()]
        table = _parse([f"{k}{_delimiter(file)}{lines[k]}" for k in some], file, ["_line", *(f"{k}:{c}" for k, c in enumerate(have))]) if some else None
        taken = np.array([int(x) for x in table.column(0).to_pylist()], np.int64) if some else np.zeros(0, np.int64)
        n = len(taken)
        column = lambda f: table.column(1 + have.index(at[f])).combine_chunks()
        cells, seen, times = [], pa.array([False] * n, pa.bool_()), [pa.nulls(n, pa.float64())] * len(_TIMES)
        for f in fields:
            if f == "t" and f in at and n:
                texts = column(f)
                seen = texts.is_valid()
                found = time_candidates(texts.to_pandas())
                times = [pa.array(found[c], pa.float64(), from_pandas=True) for c in _TIMES]
                cells.append(pa.nulls(n, pa.float64()))
            else:
                cells.append(_number(column(f), at[f], strict=f in ("x", "z")) if f in at and n else pa.nulls(n, pa.float64()))
        pick = pa.array(taken)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), batch.column(2).take(pick), batch.column(5).take(pick), pa.nulls(n, pa.string()), seen, *times, *cells], names=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            of = coded.indices.to_numpy(zero_copy_only=False)
            for k, file in enumerate(coded.dictionary.to_pylist()):
                mine = batch.take(pa.array(np.flatnonzero(of == k)))
                try:
                    yield rows(file, mine.column(3)[0].as_py(), mine)
                except (ValueError, KeyError, pa.ArrowException) as e:
                    yield pa.RecordBatch.from_arrays([mine.column(0)[:1], mine.column(1)[:1], mine.column(2)[:1], mine.column(5)[:1], pa.array([str(e)[:200]]), pa.array([False]), *[pa.nulls(1, pa.float64()) for _ in (*_TIMES, *fields)]], names=out)

    found = both.mapInArrow(run, schema)
    whole = Window.partitionBy("file")
    order = Window.partitionBy("file").orderBy("block", "spot")
    wrong = F.min(F.when(F.col("problem").isNotNull(), F.struct("block", "spot", "problem"))).over(whole)
    found = found.withColumns({"_wrong": wrong, "_t": time_of(F.col("seen"), whole)})
    if "t" in fields:
        known = F.max(F.col("seen").cast("int")).over(whole) == 1
        place = (F.row_number().over(order) - 1).cast("double")
        found = found.withColumn("t", F.when(known, F.col("_t")).otherwise(place if count_time else F.lit(None).cast("double")))
    first = (F.col("_wrong.block") == F.col("block")) & (F.col("_wrong.spot") == F.col("spot")) & F.col("problem").isNotNull()
    return found.where(F.col("_wrong").isNull() | first).select("file", "problem", F.when(F.col("problem").isNull(), F.row_number().over(order) - 1).otherwise(0).cast("long").alias("_place"), *[F.when(F.col("problem").isNull(), F.col(f"`{f}`")).alias(f) for f in fields])


def _parquet_rows(spark: SparkSession, path: str, pattern: str, names: dict[str, str], fields: tuple[str, ...], positional: bool, count_time: bool) -> DataFrame:
    columns = ["file", "problem", "_place", *fields]

    def one(file: str, data: bytes) -> pa.RecordBatch:
        table = pq.read_table(io.BytesIO(data))
        at = _columns(table.column_names, names, positional)
        n, cells = len(table), []
        for f in fields:
            if f not in at:
                cells.append(pa.array(range(n), pa.float64()) if f == "t" and count_time else pa.nulls(n, pa.float64()))
            elif f == "t" and pa.types.is_string(table.column(at[f]).type):
                cells.append(pa.array(column_seconds(table.column(at[f]).to_pandas().astype("object")), pa.float64(), from_pandas=True))
            else:
                cells.append(_number(table.column(at[f]), at[f], strict=f in ("x", "z")))
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.nulls(n, pa.string()), pa.array(range(n), pa.int64()), *cells], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    yield one(file, data.as_py())
                except (ValueError, KeyError, OSError, pa.ArrowException) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([str(e)[:200]]), pa.array([0], pa.int64()), *[pa.nulls(1, pa.float64()) for _ in fields]], names=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").where(_is_parquet(F.col("file")))
    return named.mapInArrow(run, "file string, problem string, _place long, " + ", ".join(f"`{f}` double" for f in fields))


def parsed(spark: SparkSession, path: str, pattern: str, names: dict[str, str], fields: tuple[str, ...], *, positional: bool = False, count_time: bool = False) -> DataFrame:
    """file, problem, _place and fields: a row for each row of each file of the folder, in the file's order from 0, or one row with the first thing that is wrong with it.

    names has each field's column; columns that a file lacks are null, but x and z are needed. With positional, x, z and t
    fall back to the first three columns, with count_time t to the row's place. A value in quotes holds no line end.
    """
    how = (spark, path, pattern, names, fields, positional, count_time)
    ending = os.path.splitext(pattern)[1].lower()
    if ending in (".parquet", ".pq"):
        return _parquet_rows(*how)
    text = _text_rows(*how)
    return text if ending and "*" not in ending else text.unionByName(_parquet_rows(*how))


def empty_files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Names of files without a byte, which no source of Spark's lists; the driver reads the folder's listing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().getName() for f in found or () if f.isFile() and f.getLen() == 0)
