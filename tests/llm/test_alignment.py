import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideline.llm import alignment, catalog

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of(symbol):
    """GPT-style byte symbols, told by where the visible Latin-1 symbols leave gaps."""
    visible = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    hidden = [b for b in range(256) if b not in visible]
    return ord(symbol) if ord(symbol) in visible else hidden[ord(symbol) - 256]


def whole(libraries, text):
    """The groups of a whole text, by walking both lists of tokens byte by byte."""
    a, b = libraries
    if not text:
        return []
    want = b" " + text.encode()
    left = [(k, bytes(byte_of(c) for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    right = [(k, piece(k)) for k in b.encode(text)]
    if b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
        return []
    ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (left, right)]
    out = []
    for place, side in enumerate((left, right)):
        at, now, mine = 0, [], []
        for k, x in side:
            at += len(x)
            now.append(k)
            if at in ends[0] and at in ends[1]:
                mine.append(now)
                now = []
        out.append(mine)
    return list(zip(*out, strict=True))


def brute(libraries, pairs):
    found = [(d, whole(libraries, t)) for d, t in pairs]
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for _, g in found]
    count = Counter(p for c in links for p in c)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (d, g), c in zip(found, links, strict=True):
        sha = hashlib.sha256(";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in g).encode()).hexdigest() if g else ""
        out.append((d, sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()), sha))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.mark.parametrize("at_once", [4_000_000, 20_000])
def test_query_equals_brute_force(spark, libraries, monkeypatch, at_once):
    monkeypatch.setattr(alignment, "AT_ONCE", at_once)
    pairs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert rows(catalog.op13_alignment(spark, "/root/testdata/sf0.001")) == brute(libraries, pairs)


ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b\t\tc", "it's  don't'll 's", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ mark", "a▁b", "snow ☃ 日本語 текст 😀👩‍👩‍👧", "x" * 5000, "1234567890 3.14159 -- ...!!", "a\x00b", "　wide　 space   line", "\x1c \x1d a\x1e b", "ab\u0085 cd ᠎ ef﻿ gh", "é́ combining", "\r\n\r\n  \r\n", "\t a\t", "word " * 3000]


def test_odd_texts(spark, libraries):
    pairs = list(enumerate(ODD)) + [(3, "again"), (3, "again"), (None, "no id it's"), (900, "a")]
    docs = spark.createDataFrame(pairs, "doc_id int, text string").withColumns({"chunk": F.lit(1), "n_a": F.lit("x"), "pairs": F.lit(2)}).repartition(3)
    found, known = alignment.align(docs, A, B)
    assert rows(found) == brute(libraries, pairs)
    counts = Counter(p for _, t in pairs for p in {(x, y) for ga, gb in whole(libraries, t) for x in ga for y in gb})
    assert {(r["a"], r["b"]): r["documents"] for r in known.collect()} == counts
    empty, pairs_of_none = alignment.align(docs.limit(0), A, B)
    assert empty.count() == 0 and pairs_of_none.count() == 0


def test_stretches_equal_whole_texts(libraries, monkeypatch):
    """Random texts of many kinds of white space, marks and scripts, cut or not."""
    aligner, draw = alignment.Aligner(A, B), random.Random(7)
    assert aligner.cuts
    symbols = [" ", " ", " ", "  ", "\n", "\t", " ", "　", " ", "\u0085", "\x1f", "​", "᠎", "a", "the", "The", "'s", "'", "n't", "12", "7", "é", "ß", "日本", "и", "☃", "😀", ".", "...", "--", "_", "\x00", "<s>", "<|endoftext|>", "▁"]
    texts = ["".join(draw.choice(symbols) for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    found = [aligner.stretches(t) for t in texts]
    cut, alone = [c for c, _ in found], set().union(*(x for _, x in found))
    every = sorted((s for c in cut for s in c), key=lambda s: s in alone)
    place = {s: k for k, s in enumerate(every)}
    for together in (4096, 5):
        monkeypatch.setattr(alignment, "TOGETHER", together)
        found = aligner.align(pa.array(every, pa.large_string()), sum(s not in alone for s in every))
        said, good = found.texts.to_pylist(), found.whole.tolist()
        for text, c in zip(texts, cut, strict=True):
            want = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in whole(libraries, text))
            got = b"".join(said[place[s]] for s in c).decode()[:-1] if all(good[place[s]] for s in c) else ""
            assert got == want, repr(text)


def test_groups_by_interval_index():
    a, b = alignment.groups(np.array([1, 4, 5, 9]), np.array([2, 4, 7, 8, 9]))
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 0, 1, 1, 1]
    draw = np.random.default_rng(3)
    for _ in range(200):
        n = int(draw.integers(1, 30))
        a, b = (np.unique(np.append(draw.integers(1, n + 1, int(draw.integers(0, 12))), n)) for _ in range(2))
        both = sorted(set(a.tolist()) & set(b.tolist()))
        for ends, of in zip((a, b), alignment.groups(a, b)):
            assert of.tolist() == [sum(x < e for x in both) for e in ends.tolist()]


@pytest.mark.parametrize("at_once", [1 << 20, 3])
def test_linked_counts_all_pairs(monkeypatch, at_once):
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", at_once)
    draw = np.random.default_rng(4)
    for _ in range(50):
        n = int(draw.integers(1, 5))
        of_a, of_b = (np.sort(np.concatenate((np.arange(n), draw.integers(0, n, 9)))) for _ in range(2))
        a, b = draw.integers(0, 4, len(of_a)), draw.integers(0, 4, len(of_b))
        owner = np.sort(draw.integers(0, 3, n))
        want = Counter((o, x, y) for x, g in zip(a.tolist(), of_a) for y, h in zip(b.tolist(), of_b) if g == h for o in (int(owner[g]),))
        owners, pairs, counts = alignment.linked(a, b, of_a, of_b, owner)
        assert {(o, p >> 32, p & 0xFFFFFFFF): c for o, p, c in zip(owners.tolist(), pairs.tolist(), counts.tolist())} == want
        assert owners.tolist() == sorted(owners.tolist())
