import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.llm import catalog, media

SF = "/root/testdata/sf0.001"


def expected(text):
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
    return len(raw), payload


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalog.op8_media(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        n, payload = expected(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) and len(payload) % 192 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        png = media.to_png(payload, n)
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())


def test_edge_cases_and_ranges(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "é" * 96), (3, "é" * 96), (4, "x" * 100_000), (-5, "\x00\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("payload", F.lit("p")).repartition(2)
    path = f"file://{tmp_path}/a"
    media.write_archives(media.images(docs), path)
    media.write_archives(media.images(docs.limit(0)), path)
    for size in (300, 1 << 20):
        back = media.decoded(media.read_archives(spark, path, range_bytes=size)).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], bytes(r["payload"])) for r in back), key=str) == sorted(((k, *expected(t)) for k, t in rows), key=str)
    assert media.decoded(docs.select("doc_id", F.lit(None).cast("binary").alias("media"))).where("payload is null").count() == len(rows)
    (tmp_path / "a" / "part-of-a-lost-task.zip").write_bytes(b"half")
    assert media.read_archives(spark, path).count() == len(rows)


def test_members_are_retried_alone(tmp_path):
    store, root = media._open(f"file://{tmp_path}")
    import pyarrow as pa

    batch = pa.record_batch({"doc_id": [1, 2], "media": [b"one", b"two"]})
    writer = media.ArchiveWriter(f"file://{tmp_path}")
    name = writer.write(iter([batch])).found[0][0]
    members = media._members(store, f"{root}/{name}")
    calls = []

    def flaky(*args):
        calls.append(args)
        if len(calls) < 3:
            raise OSError("lost")
        return media._fetch(*args)

    offset, _, size, crc = members[1]
    assert media.again(flaky, store, f"{root}/{name}", offset, size, crc, pause=0) == b"two" and len(calls) == 3
    with pytest.raises(OSError):
        media.again(media._fetch, store, f"{root}/{name}", offset, size, crc + 1, pause=0)


def test_damaged_image():
    png = media.to_png(b"a" * 192)
    assert media.from_png(png)[0].tobytes() == b"a" * 192
    with pytest.raises(ValueError):
        media.from_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])
    with pytest.raises(ValueError):
        media.from_png(b"GIF89a" + png)


def test_feature_by_hand():
    for raw in (b" " * 192, bytes(range(256)) * 3, b"abc" * 64 + b"\xff" * 192):
        bins = [1000 * sum(b // 16 == k for b in raw) // len(raw) for k in range(16)]
        assert media.feature(np.frombuffer(raw, np.uint8).reshape(-1, 192)) == f"rows={len(raw) // 192};mean={1000 * sum(raw) // len(raw)};bins={','.join(map(str, bins))}"
