import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideline.llm import catalog, tokenfiles
from strideline.llm.common import remove, scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")


def expected(pairs):
    """Documents in ascending order of id with their place, from the library."""
    library, at, out = Tokenizer.from_file(WORDS), 0, []
    for doc_id, text in sorted(pairs, key=lambda p: (p[0] is None, p[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_the_library(spark, sf):
    pairs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = catalog.op12_tokenfiles(spark, f"/root/testdata/{sf}").orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(d, at, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for d, at, n, ids in expected(pairs)]


def test_odd_rows_round_trip_and_random_access(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "READ_IDS", 50)
    long = "wide words, mixed Ünïcode 12345 ... " * 3000
    pairs = [(9, "last one"), (3, None), (4, ""), (5, long), (-2, "negative id"), (7, "a\nb\t c  d"), (11, "<|endoftext|> in a text"), (1, "first")]
    docs = spark.createDataFrame(pairs + [(None, "no id")], "doc_id long, text string").withColumns({"part": F.lit("x"), "ids": F.lit(1), "_hash": F.lit(2), "n": F.lit(3)}).repartition(4)
    path = scratch_path(spark, "files")
    tokenfiles.write(docs, path, WORDS, part_bytes=20_000)
    want = expected(pairs + [(None, "no id")])
    assert sorted(map(tuple, tokenfiles.read(spark, path).collect()), key=lambda r: r[1]) == want
    files = tokenfiles.TokenFiles(path)
    assert len(files) == len(want) and [files[k].tolist() for k in range(len(want))] == [w[3] for w in want]
    assert files[0].dtype == np.dtype("<u2")
    with pytest.raises(IndexError):
        files[len(want)]
    parts = sorted(map(tuple, spark.read.parquet(f"{path}/parts").select("part", "documents", "ids", "documents_before", "ids_before").collect()))
    assert len(parts) > 2
    for a, b in zip(parts, parts[1:]):
        assert b[3:] == (a[3] + a[1], a[4] + a[2])


def test_repeated_ids_strings_as_ids_and_leftover_files(spark):
    docs = spark.createDataFrame([("b", "two")] * 30 + [("a", "one")] * 2 + [("b", "other")], "doc_id string, text string").repartition(5)
    path = scratch_path(spark, "files")
    tokenfiles.write(docs, path, WORDS, part_bytes=10)
    found = sorted(tokenfiles.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == ["a"] * 2 + ["b"] * 31
    assert [r["start"] for r in found] == list(np.cumsum([0] + [r["n_tokens"] for r in found])[:-1])
    assert len({tuple(r["ids"]) for r in found}) == 3
    root = path.removeprefix("file://")
    with open(f"{root}/left.bin", "wb") as f:
        f.write(b"1")
    tokenfiles._tidy(path, {r["name"] for r in spark.read.parquet(f"{path}/parts").collect()})
    assert len(tokenfiles.TokenFiles(path)) == 33
    with pytest.raises(FileNotFoundError):
        open(f"{root}/left.bin")
    remove(spark, path)


def test_empty_table(spark):
    path = scratch_path(spark, "files")
    tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), path, WORDS)
    assert tokenfiles.read(spark, path, digest=True).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert tokenfiles.read(spark, path).count() == 0 and len(tokenfiles.TokenFiles(path)) == 0


def test_wide_ids_take_four_bytes(spark, tmp_path):
    library = Tokenizer.from_file(WORDS)
    library.add_tokens([f"zz{k}zz" for k in range(20_000)])
    library.save(str(tmp_path / "wide.json"))
    path = scratch_path(spark, "files")
    tokenfiles.write(spark.createDataFrame([(1, "a zz19999zz b"), (2, "c")], "doc_id long, text string"), path, str(tmp_path / "wide.json"))
    files = tokenfiles.TokenFiles(path)
    assert files[0].dtype == np.dtype("<u4") and files[0].tolist() == [*library.encode("a zz19999zz b", add_special_tokens=False).ids, 1]
