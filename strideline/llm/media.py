"""Media columns: texts as 8-bit grey images in archives, written and read by a custom Spark data source.

A document's UTF-8 bytes, padded to whole rows, become the samples of a PNG image. Tasks write their images as stored
members of ZIP archives into a folder that driver and executors share; what a failed or repeated task leaves behind is
in no manifest and is never read. The reader plans byte ranges over the archives from the manifests alone (names and
sizes); a task reads its archive's directory, takes the members that start in its range, and streams them through
Arrow in batches of bounded size. Each member is fetched, checked and, if need be, fetched again by its offset, so one
bad read does not repeat the range.
"""

from __future__ import annotations

import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strideline.llm.common import map_texts

WIDTH = 192
FORMAT = "strideline_media"
SCHEMA = "doc_id long, media binary, archive string, offset long"
#: Bytes of an archive, of a planned range and of an Arrow batch; a single member may be larger.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 16 << 20, 4 << 20
ATTEMPTS = 4
_SIGNATURE, _LENGTH = b"\x89PNG\r\n\x1a\n", b"Length\x00"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes, length: int | None = None, width: int = WIDTH) -> bytes:
    """Bytes of whole rows as an 8-bit grey PNG; length, the bytes before padding, goes into a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each line's first byte: no filter
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    text = _chunk(b"tEXt", _LENGTH + str(len(payload) if length is None else length).encode())
    return _SIGNATURE + _chunk(b"IHDR", head) + text + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """The samples (rows by width) and the noted length of an image of to_png(); ValueError for a damaged one."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, size, length = 8, b"", None, None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, depth, color, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, color) != (8, 0):
                raise ValueError("not 8-bit grey")
            size = height, width
        elif kind == b"tEXt" and body.startswith(_LENGTH):
            length = int(body[len(_LENGTH) :])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if size is None:
        raise ValueError("no header")
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[0], size[1] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not supported")
    return lines[:, 1:], size[0] * size[1] if length is None else length


def feature(samples: np.ndarray) -> str:
    """Rows, mean and a 16-bin histogram in thousandths of an image, in integer arithmetic."""
    counts = np.bincount(samples.reshape(-1) >> 4, minlength=16)
    total = int(np.sum(samples, dtype=np.int64))
    return f"rows={len(samples)};mean={1000 * total // samples.size};bins={','.join(str(1000 * int(c) // samples.size) for c in counts)}"


def images(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, media: each whole text's image. Null counts as empty, which is one row of spaces; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                media = [to_png(t.ljust(max(1, -(-len(t) // WIDTH)) * WIDTH), len(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text")), run, "doc_id long, media binary")


def decoded(media: DataFrame) -> DataFrame:
    """doc_id, media, n_bytes, payload, feature: what each stored image holds; null media gives nulls."""
    schema = T.StructType([media.schema["doc_id"], *(T.StructField(n, t) for n, t in (("media", T.BinaryType()), ("n_bytes", T.LongType()), ("payload", T.BinaryType()), ("feature", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [(None, None) if m is None else from_png(m) for m in part.column(1).to_pylist()]
                payload = [None if s is None else s.tobytes() for s, _ in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([n for _, n in found], pa.int64()), pa.array(payload, pa.binary()), pa.array([None if s is None else feature(s) for s, _ in found], pa.string())], names=schema.names)

    return map_texts(media.select("doc_id", "media"), run, schema)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass
class Archives(WriterCommitMessage):
    found: list[tuple[str, int]]


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    stop: int


class ArchiveWriter(DataSourceArrowWriter):
    """Writes doc_id and media as archives of about ARCHIVE_BYTES each; commit() lists those of the tasks that count."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        found, number = [], 0
        batch_rows = ((k, m) for batch in iterator for k, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True) if m is not None)
        row = next(batch_rows, None)
        while row is not None:
            name, size = f"part-{uuid.uuid4().hex}.zip", 0
            with store.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                while row is not None and size < ARCHIVE_BYTES:
                    key, media = row
                    member = zipfile.ZipInfo(f"{number}-{'' if key is None else key}.png")
                    archive.writestr(member, media)
                    number, size = number + 1, size + len(media)
                    row = next(batch_rows, None)
            found.append((name, store.get_file_info(f"{root}/{name}").size))
        return Archives(found)

    def commit(self, messages: list[Archives | None]) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        lines = [f"{size}\t{name}\n" for m in messages if m for name, size in m.found]
        with store.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}") as out:
            out.write("".join(lines).encode())

    def abort(self, messages: list[Archives | None]) -> None:
        store, root = _open(self.path)
        for name in (name for m in messages if m for name, _ in m.found):
            store.delete_file(f"{root}/{name}")


def _members(store: fs.FileSystem, path: str) -> list[tuple[int, str, int, int]]:
    """Offset, name, size and checksum of an archive's members, from its directory."""
    with store.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
        return [(m.header_offset, m.filename, m.compress_size, m.CRC) for m in archive.infolist()]


def _fetch(store: fs.FileSystem, path: str, offset: int, size: int, crc: int) -> bytes:
    with store.open_input_file(path) as f:
        head = f.read_at(30, offset)
        name, extra = struct.unpack_from("<HH", head, 26)
        data = f.read_at(size, offset + 30 + name + extra)
    if head[:4] != b"PK\x03\x04" or len(data) != size or zlib.crc32(data) != crc:
        raise OSError(f"member at {offset} of {path} is damaged")
    return data


def again(attempt, *args, attempts: int = ATTEMPTS, pause: float = 0.2):
    """attempt(*args), repeated with growing pauses while it raises OSError or finds a bad archive."""
    for k in range(attempts):
        try:
            return attempt(*args)
        except (OSError, struct.error, zipfile.BadZipFile):
            if k == attempts - 1:
                raise
            time.sleep(pause * 2**k)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        store, root = _open(self.path)
        plan = []
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("manifest-"):
                with store.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        size, name = line.split("\t")
                        plan += [Range(name, at, at + self.range_bytes) for at in range(0, int(size), self.range_bytes)]
        return plan or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, root = _open(self.path)
        path = f"{root}/{partition.archive}"
        rows, held = [], 0
        for offset, name, size, crc in again(_members, store, path):
            if partition.start <= offset < partition.stop:
                key = name.rpartition(".")[0].partition("-")[2]
                rows.append((int(key) if key else None, again(_fetch, store, path, offset, size, crc), partition.archive, offset))
                held += size
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.binary(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "media", "archive", "offset"])


class MediaArchives(DataSource):
    """spark.read/df.write.format(FORMAT) on a folder of archives; option range_bytes sets the planned ranges."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def write_archives(media: DataFrame, path: str) -> None:
    """Appends doc_id and media (rows with null media are left out) to the archives in a folder that all tasks reach."""
    media.sparkSession.dataSource.register(MediaArchives)
    media.select("doc_id", "media").write.format(FORMAT).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, media, archive, offset of every member of the folder's archives; a folder that was never written to gives an error, an empty one no rows."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format(FORMAT).option("range_bytes", range_bytes).load(path)
