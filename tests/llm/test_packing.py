import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "Hello, WORLD!! it's don't I'LL 123 4.5, x.,. a.b ...", "<|startoftext|> and <|ENDOFTEXT|>x", "É́Å Σίσυφος ΣΑΣ İİ ß ﬁ",
    "a\x1cb\x85c d e\x0bf\tg\n\nh", "'s 'S x's,, .,.,", "日本語、テキスト。🙂🙂 a🙂.", "word " * 5000, "٣٤٥ ½ x²", "é. ,́ a,́",
]


LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for k, text in texts.items():
        ids, at = expected(text), 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, parts in by_sequence.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 if s < len(by_sequence) - 1 else 0 < at <= 2048


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(packing.pack(docs, PATH).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_edge_cases(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("ids", F.lit("x")).repartition(3)
    check(packing.pack(docs, PATH).collect(), dict(enumerate(ODD)))
    assert packing.pack(docs.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    assert packing.pack(twice, PATH).agg(F.sum("length")).first()[0] == 10


def test_sequences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    placed = packing.placed(docs, PATH)
    flat = np.concatenate([np.frombuffer(r["ids"], "<u2") for r in placed.orderBy("at").collect()])
    rows = packing.sequences(placed, pad_id=7).orderBy("sequence_id").collect()
    assert [r["sequence_id"] for r in rows] == list(range(-(-len(flat) // 2048)))
    assert np.array_equal(np.concatenate([r["ids"][: r["tokens"]] for r in rows]), flat)
    assert all(len(r["ids"]) == 2048 for r in rows) and set(rows[-1]["ids"][rows[-1]["tokens"] :]) <= {7}


def test_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    coder = packing.WordTokens(PATH)
    texts = [f"some words, number{k} and wörd{k}. again" for k in range(50)]
    for t in texts:
        assert [*np.frombuffer(coder.encode([t.encode()])[0], coder.width)] == expected(t)[:-1]


def test_every_letter_before_punctuation():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = [f"a{chr(k)}{end}" for k in range(0x10000) if chr(k).isalpha() for end in (".", ",")]
    found = packing.WordTokens(path).encode([w.encode() for w in words])
    library = Tokenizer.from_file(path).encode_batch(words, add_special_tokens=False)
    assert [w for w, x, y in zip(words, found, library) if np.frombuffer(x, "<u2").tolist() != y.ids] == []


def test_other_tokenizer_files_go_through_the_library_whole(tmp_path):
    tokens = packing.WordTokens(PATH)
    assert tokens.by_words
    other = public_tokenizers.path("byte_bpe_50k.json")
    tokens, library = packing.WordTokens(other), Tokenizer.from_file(other)
    assert not tokens.by_words
    texts = ["a  b\n c", "", "word word.  word"]
    assert [np.frombuffer(x, tokens.width).tolist() for x in tokens.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 8)
    tokens = packing.WordTokens(PATH)
    texts = [x.encode() for x in ODD if x is not None]
    for k in range(0, len(texts), 3):
        assert [np.frombuffer(x, tokens.width).tolist() for x in tokens.encode(texts[k : k + 3])] == [expected(t.decode())[:-1] for t in texts[k : k + 3]]
