"""Concatenate-and-cut packing of tokenized documents into fixed windows.

Two passes. The first tokenizes every document once and writes its ids with the partition it came from and the count of
ids before it there. The partitions' totals (one row for each task of the first pass) give each partition's global
offset by a prefix sum, and the second pass cuts documents at the global window borders without moving any text.
A document may lie in many windows and a window may hold many documents; only the windows that cross a task border are
put together through a shuffle, by sequence_id, where each has at most one window of ids.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.common import Memory, held, map_texts, scratch_path

WINDOW = 2048
#: Words that a Python worker remembers at most.
REMEMBERED = 500_000
#: Bytes of a word that is remembered at most.
LONGEST = 64
#: Bytes of text that are tokenized at a time.
AT_ONCE = 4_000_000
# The word pattern of the tokenizer files that are encoded word by word, punctuation that its last
# alternative matches alone or after letters alike, and the first byte of marks that compose with ASCII letters (their
# case matters before they do).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TAIL = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
MARKS = b"\xcc"


def _letters(core: str) -> bool:
    """Whether a word is letters only and stays so when it is normalised: one token run for the tokenizer, also before punctuation."""
    return core.isalpha() and (core.isascii() or unicodedata.normalize("NFC", unicodedata.normalize("NFC", core).lower()).isalpha())


def _by_words(spec: dict) -> bool:
    """Whether a tokenizers file drops white space and encodes what lies between piece by piece, so that words can be encoded one by one."""
    normalizer, cutter, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = [x.get("type") for x in normalizer.get("normalizers", [])]
    split, *rest = cutter.get("pretokenizers", [{}])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and normalizer["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
        and normalizer["normalizers"][1].get("content") == " "
        and (split.get("type"), split.get("behavior"), split.get("invert"), split.get("pattern", {}).get("Regex")) == ("Split", "Removed", True, WORD_PATTERN)
        and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
        and (model.get("type"), model.get("dropout"), model.get("fuse_unk")) == ("BPE", None, False)
        and bool(model.get("end_of_word_suffix"))
    )


class WordTokens:
    """Ids of whole texts by a tokenizers file.

    A file of the make-up that _by_words() checks encodes a text as its space-separated words one after another. Then a
    chunk of texts is cut into words and reduced to its distinct ones in Arrow, only words that the worker doesn't
    remember go through the library (plain letters all at once, told apart by their word ends), and Arrow puts the ids
    of the words back in the texts' order. Texts that hold an added token's string, in any case, go through the library
    whole, and with a file of any other make-up all texts do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's own threads would only wait for work on others'
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.by_words = _by_words(spec)
        self.added = [x["content"].lower().encode() for x in spec.get("added_tokens", [])]
        vocab = self.library.get_vocab()
        most = max(vocab.values(), default=0) + 1
        self.width = np.dtype("<u2" if most <= 1 << 16 else "<u4")
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(most, bool)
        self.ends[[k for piece, k in vocab.items() if suffix and piece.endswith(suffix)]] = True
        self.memory = Memory(REMEMBERED)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [np.array(x.ids, self.width).tobytes() for x in found]

    def _letter_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, each of which ends in the only piece with the word end."""
        if not words:
            return []
        ids = np.array(self.library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.width)
        ends = (np.flatnonzero(self.ends[ids]) + 1) * self.width.itemsize
        if len(ends) != len(words) or ends[-1] != ids.nbytes:
            return self._encode(words)
        data, last = ids.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip([0, *last], last)]

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words; those short enough are remembered."""
        known, recall = self.memory.now, self.memory.recall
        cut = {w: core for w in new if len(core := w.rstrip(TAIL)) != len(w) and core and _letters(core.decode())}
        plain = dict.fromkeys(w for w in new if w not in cut)
        plain |= dict.fromkeys(x for w, core in cut.items() for x in (core, w[len(core) :]))
        found = {w: ids for w in plain if (ids := known.get(w) or recall(w)) is not None}
        letters: list[bytes] = []
        others: list[bytes] = []
        for w in plain:
            if w not in found:
                (letters if _letters(w.decode()) else others).append(w)
        found.update(zip(letters, self._letter_words(letters), strict=True))
        found.update(zip(others, self._encode(others), strict=True))
        found.update([(w, found[core] + found[w[len(core) :]]) for w, core in cut.items()])
        known.update((w, ids) for w, ids in found.items() if len(w) <= LONGEST)
        return found

    def _words(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts without added tokens."""
        self.memory.turn()
        known, recall = self.memory.now, self.memory.recall
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        coded = words.flatten().view(pa.large_binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = list(map(known.get, distinct))
        open_ = [k for k, x in enumerate(ids) if x is None]
        for k in open_:
            ids[k] = recall(distinct[k])
        new = {distinct[k] for k in open_ if ids[k] is None}
        if new:
            found = self._learn(sorted(new))
            for k in open_:
                if ids[k] is None:
                    ids[k] = found[distinct[k]]
        joined = pa.array(ids, pa.large_binary()).take(coded.indices)
        places = np.concatenate(([0], np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False))))[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        data = b"".join(joined.to_pylist()) if not len(joined) else joined.buffers()[2].to_pybytes()
        return [data[a:b] for a, b in zip(places, places[1:])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, packed in self.width."""
        out: list[bytes | None] = [None] * len(texts)
        some, lowered = [], []
        for k, text in enumerate(texts):
            low = text.lower()
            if not self.by_words or any(x in low for x in self.added):
                out[k] = self._encode([text])[0]
            else:
                some.append(k)
                lowered.append(text if MARKS in text else low)
        if some:
            for k, ids in zip(some, self._words(lowered), strict=True):
                out[k] = ids
        return out


def _tokens(path: str) -> WordTokens:
    """One for each Python worker, which keeps what it has learnt from task to task."""
    return held(("tokens", path), lambda: WordTokens(path))


def tokenize(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *, end_id: int = 1) -> DataFrame:
    """doc_id, part, before, ids: the first pass. ids are packed little-endian (two bytes each in a vocabulary of up to 65,536) and end in end_id; before counts the ids of the documents that part had before."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = _tokens(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.width).tobytes()
        for batch in batches:
            at, sizes = 0, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(sizes)
            while at < len(batch):
                until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE)))
                ids = [x + end for x in coder.encode([x or b"" for x in batch.column(1)[at:until].to_pylist()])]
                n = np.array([len(x) for x in ids], np.int64) // coder.width.itemsize
                starts = before + np.concatenate(([0], np.cumsum(n)[:-1]))
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:until], pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(n), pa.array(ids, pa.binary())], names=schema.names)
                at = until

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("_text")), run, schema)


def placed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *, end_id: int = 1) -> DataFrame:
    """doc_id, at, n, ids: each document's ids and the place of their first in the concatenation of all."""
    spark = docs.sparkSession
    first = tokenize(docs, tokenizer, doc_id, text, end_id=end_id)
    path = scratch_path(spark, "tokens")
    first.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(first.schema).parquet(path)
    totals = written.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row for each task
    base = spark.createDataFrame([(r["part"], int(b)) for r, b in zip(totals, np.cumsum([0, *(r["n"] for r in totals)]))], "part int, base long")
    return written.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")


def pieces(documents: DataFrame, *, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, start, length, ids (or their ids_crc32), doc_tokens, sequence_id, offset: each document of placed() cut at the window borders.

    start counts the document's ids before the piece, offset the sequence's; every id is in exactly one piece. With
    digest, ids_crc32 is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    last = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.IntegerType()))
    names = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([documents.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in names), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(k).to_numpy() for k in (1, 2))
            if not len(at):
                continue
            first, final = at // window, (at + n - 1) // window
            count = final - first + 1
            doc = np.repeat(np.arange(len(at)), count)
            sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            begin, finish = np.maximum(at[doc], sequence * window), np.minimum((at + n)[doc], (sequence + 1) * window)
            start, length = begin - at[doc], finish - begin
            cut: list = []
            held, raw = -1, None
            for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                if d != held:
                    data = batch.column(3)[d].as_buffer()
                    held, raw = d, np.frombuffer(data, f"<u{data.size // n[d]}").astype("<u4")
                cut.append(zlib.crc32(raw[s : s + k]) if digest else raw[s : s + k])
            body = pa.array(cut, pa.int64()) if digest else pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in (start, length, n[doc], sequence, begin - sequence * window)), body], names=schema.names)

    return map_texts(documents.select("doc_id", "at", "n", "ids"), run, schema)


def sequences(documents: DataFrame, *, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, tokens, ids: the packed windows of placed(), the last padded with pad_id to the window; tokens counts the others.

    Tasks put together the windows that they hold whole and pass the rest on as boundary records, which meet by
    sequence_id.
    """
    schema = "sequence_id long, whole boolean, offset long, ids array<int>"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32())))], names=["sequence_id", "whole", "offset", "ids"])

        for batch in batches:
            rows = []
            for s, o, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                parts = held.setdefault(s, [])
                parts.append((o, ids.values.to_numpy()))
                if sum(len(x) for _, x in parts) == window:
                    rows.append((s, True, 0, np.concatenate([x for _, x in sorted(held.pop(s), key=lambda p: p[0])])))
                elif len(held) > 64:  # rows out of order: what is oldest meets its rest in the shuffle
                    old = next(iter(held))
                    rows += [(old, False, o, x) for o, x in held.pop(old)]
            if rows:
                yield out(rows)
        rows = [(s, False, o, x) for s, parts in held.items() for o, x in parts]
        if rows:
            yield out(rows)

    found = pieces(documents, window=window).select("sequence_id", "offset", "ids").mapInArrow(local, schema)
    rest = found.where("not whole").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # a window of ids at most
    both = found.where("whole").select("sequence_id", "ids").union(rest.select("sequence_id", F.flatten("parts.ids")))
    return both.select("sequence_id", F.size("ids").alias("tokens"), F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("ids"))).alias("ids"))


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """The pieces of all docs, with their checksums.

    Null texts count as empty and an empty text has its end id alone; null and repeated ids are packed like others, row
    by row; other columns are ignored; no rows give none.
    """
    return pieces(placed(docs, tokenizer, doc_id, text, end_id=end_id), window=window, digest=True)
