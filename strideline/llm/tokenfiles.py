"""Token ids as flat binary files with 64-bit document offsets, which readers map into memory.

A folder holds, for each part, `<name>.bin` (the ids of its documents one after another, as unsigned little-endian
integers of two or four bytes), `<name>.idx` (unsigned 64-bit offsets, in ids: where each of its documents begins, then
their end) and `<name>.ids` (their doc_ids, an Arrow file of one column). `parts` is a Parquet table with a row for each
part: its order, name, documents, ids and, by prefix sums over the parts, how many documents and ids are before it, so a
document's place in the whole corpus is its part's base and its offset there.

Documents are dealt by ranges of doc_id and sorted there. A task tokenizes its range, each document once, streams the
ids into files of its own and reports one row; what a failed or repeated attempt left behind is in no row, is never
read, and goes at the end. Rows of equal doc_id are told apart by their texts and then by row, so no key is too hot.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from strideline.llm.common import cores, map_texts, release
from strideline.llm.packing import AT_ONCE, _tokens

#: Bytes of text of a part, about; parts are ranges of documents, and a document is never cut.
PART_BYTES = 256 << 20
#: Ids that a reading task holds at a time, beside a document that has more.
READ_IDS = 1 << 20
_PARTS = "part long, name string, documents long, ids long, documents_before long, ids_before long, width int"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _mapped(store: fs.FileSystem, path: str) -> pa.NativeFile:
    """A file to read from: mapped into memory where the store is a local or mounted folder, else read by ranges."""
    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *, end_id: int = 1, part_bytes: int = PART_BYTES) -> None:
    """Writes the ids of all docs into a new folder, in ascending order of doc_id.

    Null texts count as empty, and an empty text has its end id alone. Null ids come last, rows that repeat an id in the
    order of a hash of their texts; other columns are not read; no rows give an empty table of parts.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    order = [F.asc_nulls_last("doc_id"), F.asc("_hash"), F.asc("_row")]
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("_text"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ranged = keyed.repartitionByRange(max(cores(spark), -(-total // part_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next((b for b in batches if len(b)), None)
        if batch is None:
            return
        coder, (store, root) = _tokens(tokenizer), _store(path)
        store.create_dir(root, recursive=True)
        end, width = np.array([end_id], coder.width).tobytes(), coder.width.itemsize
        part, name, at, rows = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, 0
        with store.open_output_stream(f"{root}/{name}.bin") as ids, store.open_output_stream(f"{root}/{name}.idx") as idx, store.open_output_stream(f"{root}/{name}.ids") as keys:
            with pa.ipc.new_file(keys, pa.schema([("doc_id", batch.schema.field(0).type)])) as table:
                while batch is not None:
                    for texts in _chunks(batch.column(1)):
                        found = [x + end for x in coder.encode([t or b"" for t in texts.to_pylist()])]
                        starts = at + np.cumsum([0, *map(len, found)], dtype=np.int64) // width
                        ids.write(b"".join(found))
                        idx.write(starts[:-1].astype("<u8").tobytes())
                        at = int(starts[-1])
                    table.write_batch(pa.RecordBatch.from_arrays([batch.column(0)], names=["doc_id"]))
                    rows += len(batch)
                    batch = next((b for b in batches if len(b)), None)
            idx.write(np.array([at], "<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (name, pa.string()), (rows, pa.int64()), (at, pa.int64()), (width, pa.int32()))], names=["part", "name", "documents", "ids", "width"])

    found = sorted(map_texts(ranged, run, "part long, name string, documents long, ids long, width int").collect())  # one row for each part
    bases = np.cumsum([[0, 0], *([r["documents"], r["ids"]] for r in found)], axis=0).tolist()
    lines = [(k, r["name"], r["documents"], r["ids"], *bases[k], r["width"]) for k, r in enumerate(found)]
    spark.createDataFrame(lines, _PARTS).coalesce(1).write.parquet(f"{path}/parts")
    _tidy(path, {r["name"] for r in found})


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in slices of AT_ONCE bytes (one text at least)."""
    total, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE)))
        yield texts[at:until]
        at = until


def _tidy(path: str, names: set[str]) -> None:
    """Deletes the files of attempts that don't count."""
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    for f in store.get_file_info(fs.FileSelector(root)):
        if f.type == fs.FileType.File and f.extension in ("bin", "idx", "ids") and f.base_name.split(".")[0] not in names:
            store.delete_file(f.path)


class _Part:
    """One part's files."""

    def __init__(self, path: str, name: str, width: int):
        store, root = _store(path)
        with _mapped(store, f"{root}/{name}.idx") as f:
            self.offsets = np.frombuffer(f.read_buffer(), "<u8").astype(np.int64)
        self.file, self.width = _mapped(store, f"{root}/{name}.bin"), width
        with _mapped(store, f"{root}/{name}.ids") as f:
            self.doc_ids = pa.ipc.open_file(f).read_all().column(0).combine_chunks()

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((stop - start) * self.width, start * self.width), f"<u{self.width}")


def read(spark: SparkSession, path: str, *, digest: bool = False) -> DataFrame:
    """doc_id, start (the ids of all documents before it), n_tokens and ids of every document, from the files of write().

    With digest, ids_crc32 instead of ids: the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers. A
    task reads one part and holds READ_IDS ids or one document.
    """
    parts = spark.read.schema(_PARTS).parquet(f"{path}/parts")
    keys = _doc_id_type(path, parts)
    last = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField("doc_id", keys), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for row in (r for b in batches for r in b.to_pylist()):
            part = _Part(path, row["name"], row["width"])
            offsets, at = part.offsets, 0
            while at < row["documents"]:
                until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_IDS, "right")) - 1)
                starts, ends = offsets[at:until], offsets[at + 1 : until + 1]
                ids, cuts = part.ids(offsets[at], offsets[until]).astype("<u4"), offsets[at : until + 1] - offsets[at]
                if digest:
                    body = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())
                else:
                    body = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.doc_ids.slice(at, until - at), pa.array(starts + row["ids_before"]), pa.array(ends - starts), body], names=schema.names)
                at = until

    count = parts.count()
    return parts.repartition(max(1, count), "part").mapInArrow(run, schema)


def _doc_id_type(path: str, parts: DataFrame) -> T.DataType:
    one = parts.select("name").first()
    if one is None:
        return T.LongType()
    store, root = _store(path)
    with _mapped(store, f"{root}/{one['name']}.ids") as f:
        return from_arrow_type(pa.ipc.open_file(f).schema.field(0).type)


class TokenFiles:
    """Random access to a folder of write() for a training loader: documents by their number in ascending order of doc_id.

    Files are mapped into memory when a document of theirs is first asked for.
    """

    def __init__(self, path: str):
        store, root = _store(path)
        self.path, self.parts = path, sorted(pq.read_table(f"{root}/parts", filesystem=store).to_pylist(), key=lambda r: r["part"])
        self.before = np.array([r["documents_before"] for r in self.parts] + [sum(r["documents"] for r in self.parts)], np.int64)
        self.open: dict[int, _Part] = {}

    def __len__(self) -> int:
        return int(self.before[-1])

    def __getitem__(self, k: int) -> np.ndarray:
        if not 0 <= k < len(self):
            raise IndexError(k)
        p = int(np.searchsorted(self.before, k, "right")) - 1
        if p not in self.open:
            self.open[p] = _Part(self.path, self.parts[p]["name"], self.parts[p]["width"])
        part, k = self.open[p], k - int(self.before[p])
        return part.ids(int(part.offsets[k]), int(part.offsets[k + 1]))
