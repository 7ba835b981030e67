import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from strideline.llm import catalog, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [None, "", " ", "  ", "a", " a", "a ", "  a  b\n\nc \t☃ ", "▁x ▁ y▁▁", "<s> </s> <0x0A> <unk>", "日本語 🙂🙂x é é \x00 �", "a" * 3000, "x " * 3000, " " * 100, "\n\n\n", "aaa,bbb.ccc!!! ....... etc., (foo);", "　 z", "Ω≈ç√∫˜µ≤ ÷", "\r\nword"]


@pytest.fixture(scope="module")
def coder():
    return pieces.Pieces(PATH)


def ids(coder, text):
    import numpy as np

    return np.frombuffer(coder.encode([text])[0], "<i4").tolist()


def test_odd_texts(coder):
    for text in ODD:
        expected = LIBRARY.encode(text or "", add_eos=True)
        assert ids(coder, text) == expected, text
        assert coder.decode(expected) == LIBRARY.decode(expected)


def test_random_texts(coder):
    rng = random.Random(1)
    vocabulary = [LIBRARY.id_to_piece(k).replace("▁", " ") for k in range(259, 32000)]
    for n in range(3000):
        text = "".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))) if n % 2 else "".join(rng.choice("aeinrst  .,\nXé☃ß'") for _ in range(rng.randint(1, 40)))
        expected = LIBRARY.encode(text, add_eos=True)
        assert ids(coder, text) == expected, text
        assert coder.table("▁" + text.replace(" ", "▁")) == expected[:-1]
        assert coder.decode(expected) == LIBRARY.decode(expected)


def test_decode_any_ids(coder):
    rng = random.Random(2)
    for _ in range(3000):
        some = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 1, 2, 259]) for _ in range(rng.randint(0, 12))]
        assert coder.decode(some) == LIBRARY.decode(some), some


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for r in docs:
        e = LIBRARY.encode(r["text"], add_eos=True)
        expected.append((r["doc_id"], len(e), sha(" ".join(map(str, e))), sha(LIBRARY.decode(e))))
    assert sorted(map(tuple, catalog.op6_pieces(spark, SF).collect())) == sorted(expected)


def test_frames(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)) + [(None, "a"), (0, None)], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    rows = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert len(rows) == len(ODD) + 2
    assert {r["doc_id"]: r["decoded"] for r in rows if r["doc_id"]} == {k: LIBRARY.decode(LIBRARY.encode(t or "", add_eos=True)) for k, t in enumerate(ODD) if k}
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def test_decode_wherever_the_columns_stand(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    encoded = pieces.encode(docs, model).select(F.lit("old").alias("decoded"), "doc_id", "ids", F.lit(7).alias("more"))
    found = pieces.decode(encoded, model)
    assert found.columns == ["doc_id", "ids", "more", "decoded"]
    assert {r["doc_id"]: r["decoded"] for r in found.collect()} == {1: "a text", 2: ""}
    replaced = pieces.decode(encoded, model, out="ids")
    assert replaced.columns == ["decoded", "doc_id", "more", "ids"] and {r["ids"] for r in replaced.collect()} == {"a text", ""}


def test_new_short_words_are_filled_together(coder, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeinrstolé☃ß'.,\n🙂") for _ in range(rng.randint(1, 30)))
    texts = ["", *(" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(3000)), "x" * 200 + " y"]
    alone = []
    monkeypatch.setattr(coder, "table", lambda text, table=coder.table: alone.append(text) or table(text))
    monkeypatch.setattr(pieces, "TOGETHER", 5000)
    expected = [LIBRARY.encode(t, add_eos=True) for t in texts]
    assert [list(memoryview(x).cast("i")) for x in coder.encode(texts)] == expected
    assert "".join(alone) == "▁" + "x" * 200
    assert coder.tables(["▁"]) == [b"".join(k.to_bytes(4, "little") for k in coder.table("▁"))]


def test_pairs_stay_apart_as_merging_them_says(coder):
    rng = random.Random(4)
    tokens = [p for p in coder.piece if len(p) > 1]
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)]
    pairs += [(p[:i], p[i:]) for p in rng.sample(tokens, 1000) for i in range(1, len(p)) if coder._merged(p[:i]) == [p[:i]] and coder._merged(p[i:]) == [p[i:]]]
    found = [coder._fit(a, b) for a, b in pairs]
    assert found == [coder._merged(a + b) == [a, b] for a, b in pairs] and True in found and False in found
