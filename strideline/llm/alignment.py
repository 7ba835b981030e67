"""Alignment of two tokenizers' ids over the same texts.

Both encodings of a text are ranges of the same bytes. The ranges of the second tokenizer's tokens (B) make a static
interval index, sorted by start; bisecting it by the ends of a token of the first (A) lists the B tokens that it
overlaps. A gap between two neighbouring B tokens that no A token spans is a border of groups; inside a group every A
token is linked with every B token.

Both tokenizers begin anew at a single space between two symbols that are no white space: A's pattern takes the space
with what follows, and no piece of B has its mark after another symbol. So texts are cut there into stretches, a chunk
of texts aligns each distinct stretch once, all in one index, and a text's groups are its stretches' groups in order.
Tokenizers of other make-up have whole texts as stretches.

The counts of pairs go over all documents. A task takes texts in chunks of bounded size and writes one row for each:
its distinct stretches, their distinct pairs, and how often each document has each stretch. So a pair goes through the
shuffles once for each chunk that holds it instead of once for each document, with the number of its documents there;
the corpus-wide counts come back to the chunk by the same key, and documents are summed up chunk by chunk. No key has
more rows than there are chunks, and no chunk more than its own texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.common import held, map_texts, materialize, release

#: Bytes of text of a chunk.
AT_ONCE = 2_000_000
#: Stretches that are encoded as one text.
TOGETHER = 4096
#: Pairs of ids that are listed at a time.
PAIRS_AT_ONCE = 1 << 20
MARK = "▁"
#: A single space between symbols that are no white space.
_BORDER = re.compile(r"(?<=\S) (?=\S)")
#: White space beside a space or at a text's ends: such texts need _BORDER.
_ODD = re.compile(r"\s(?: |$)| \s|^\s")
_ROW = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]


def _byte_symbols() -> dict[str, int]:
    """The symbols that stand for bytes in byte-level vocabularies: printable Latin-1 symbols for themselves, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each A and each B token's group, from the byte offsets where the tokens end; both lists end with the last byte."""
    first = np.searchsorted(b_ends, np.concatenate(([0], a_ends[:-1])), "right")  # stabbing: the B tokens at a token's first byte
    last = np.searchsorted(b_ends, a_ends - 1, "right")  # and at its last
    n = len(b_ends)
    spans = np.cumsum(np.bincount(first + 1, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1))  # how many A tokens span the gap before each B token
    border = spans[:n] == 0
    border[:1] = False
    of_b = np.cumsum(border)
    return of_b[first], of_b


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, their distinct ids and how often each occurs there."""
    keys, n = np.unique(group.astype(np.int64) << 32 | ids, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, n


def linked(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners (of the groups, in ascending order), their distinct linked pairs (A id << 32 | B id) and how many links each has; groups are listed by their distinct ids, PAIRS_AT_ONCE pairs or one group at a time."""
    ga, ia, na = _distinct(of_a, a)
    gb, ib, nb = _distinct(of_b, b)
    lo, hi = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right")
    total, at = np.cumsum(hi - lo), 0
    found: list[tuple[np.ndarray, ...]] = []
    while at < len(ga):
        until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        size = (hi - lo)[at:until]
        left, right = np.repeat(np.arange(at, until), size), _ragged(lo[at:until], size)
        found.append(_summed(owner[ga[left]], ia[left] << 32 | ib[right], na[left] * nb[right]))
        at = until
    if len(found) > 1:
        return _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return found[0] if found else (np.zeros(0, np.int64),) * 3


def _summed(owner: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal owner and pair as one, with the sum of their n."""
    order = np.lexsort((pair, owner))
    owner, pair = owner[order], pair[order]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])))[: len(order)])
    return owner[new], pair[new], np.add.reduceat(n[order], new) if len(new) else n


@dataclass
class Aligned:
    """Stretches' alignments: which are whole, n_a, n_b, n_groups and n_links of each, its groups as text (each ends in a semicolon), how many pairs it has, and all pairs with their links."""

    whole: np.ndarray
    numbers: np.ndarray
    texts: pa.Array
    widths: np.ndarray
    pairs: np.ndarray
    links: np.ndarray


class Aligner:
    """Aligns stretches of text by a byte-level tokenizers file (A) and a SentencePiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        symbols, vocab = _byte_symbols(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, k in vocab.items():
            self.a_bytes[k] = bytes(symbols[c] for c in piece)
        self.b_bytes = [self._b_bytes(k) for k in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # ids in decimal with what follows them: A's a comma or, last in its group, a bar; B's a comma or a semicolon
        self.names = pa.array([f"{k}{mark}" for side in ((",", "|"), (",", ";")) for mark in side for k in range(len(self.a_bytes if side[1] == "|" else self.b_bytes))], pa.large_string())
        with open(a_path) as f:
            spec = json.load(f)
        cutter = spec.get("pre_tokenizer") or {}
        byte_level = not spec.get("normalizer") and (cutter.get("type"), cutter.get("add_prefix_space"), cutter.get("use_regex")) == ("ByteLevel", False, True)
        marked = (self.b.id_to_piece(k) for k in range(self.b.get_piece_size()))
        apart = all(MARK not in p.lstrip(MARK) for p in marked)
        probe = "Å Å ﬁ\t　x​  y "
        identity = self.b.decode(self.b.encode(probe)) == probe and self.b.id_to_piece(self.b.encode("a")[0]).startswith(MARK)
        self.cuts = byte_level and apart and identity

    def _b_bytes(self, k: int) -> bytes:
        if self.b.is_byte(k):
            return bytes([int(self.b.id_to_piece(k)[3:5], 16)])
        return b"" if self.b.is_control(k) or self.b.is_unknown(k) else self.b.id_to_piece(k).replace(MARK, " ").encode()

    def stretches(self, text: str) -> tuple[list[str], set[str]]:
        """A text's stretches, each without the space before it (the first one's is the added space), and those that can't be encoded together with others: they hold B's mark, or white space where they begin or end."""
        if not self.cuts:
            return [text], {text}
        marked = MARK in text
        if not marked and not _ODD.search(text):
            return text.split(" "), set()
        found = _BORDER.split(text)
        return found, {s for s in (found if marked else (found[0], found[-1])) if not s or s[0].isspace() or s[-1].isspace() or MARK in s}

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A's and B's ids of a space and text; None where either's bytes are others."""
        a, b, body = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text), b" " + text.encode()
        a_bytes, b_bytes = list(map(self.a_bytes.__getitem__, a)), list(map(self.b_bytes.__getitem__, b))
        if b"".join(a_bytes) != body or b"".join(b_bytes) != body or not all(a_bytes) or not all(b_bytes):
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def _joined(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids, and how many of them each stretch has, of stretches encoded as one text; None where that isn't all of their bytes."""
        found = self._encoded(" ".join(stretches.to_pylist()))
        if found is None:
            return None
        ends = np.cumsum(pc.binary_length(stretches).to_numpy(zero_copy_only=False) + 1)
        counts = []
        for ids, sizes in zip(found, (self.a_sizes, self.b_sizes), strict=True):
            at = np.cumsum(sizes[ids])
            last = np.searchsorted(at, ends)
            if not np.array_equal(at[last], ends):
                return None
            counts.append(np.diff(last, prepend=-1))
        return (*found, *counts)

    def _all(self, stretches: pa.Array, together: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """A's and B's ids of stretches, and how many of them each stretch has: 0 where an encoding's bytes are others. So many of the first are encoded together, as one text is cut there again."""
        none, at = np.zeros(0, np.int64), 0
        while at < len(stretches):
            until = min(together, at + TOGETHER) if at < together else len(stretches)
            some = stretches[at:until]
            joined = self._joined(some) if at < together else None
            if joined is None:
                each = [self._encoded(s) or (none, none) for s in some.to_pylist()]
                joined = np.concatenate([x for x, _ in each]), np.concatenate([y for _, y in each]), np.array([len(x) for x, _ in each]), np.array([len(y) for _, y in each])
            yield joined
            at = until

    def align(self, stretches: pa.Array, together: int) -> Aligned:
        """All stretches, as one text of which those without tokens are left out: both tokenizers' tokens end where a stretch does."""
        a, b, n_a, n_b = (np.concatenate(x) for x in zip(*self._all(stretches, together), strict=True)) if len(stretches) else (np.zeros(0, np.int64),) * 4
        size = len(stretches)
        of_a, of_b = groups(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])) if len(a) else (a, b)
        n = int(of_b[-1]) + 1 if len(b) else 0
        owner_b = np.repeat(np.arange(size), n_b)
        firsts = np.flatnonzero(np.diff(of_b, prepend=-1))
        owner = owner_b[firsts]  # of each group
        stretch, pairs, links = linked(a, b, of_a, of_b, owner)
        numbers = np.stack([n_a, n_b, np.bincount(owner, minlength=size), _sums(stretch, links, size)], axis=1).astype(np.int64).reshape(-1, 4)
        # the texts: group by group A's names, then B's
        in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[of_a]
        place_b = np.arange(len(b)) + np.cumsum(in_a)[of_b]
        name = np.empty(len(a) + len(b), np.int64)
        name[place_a] = a + len(self.a_bytes) * np.concatenate((of_a[1:] != of_a[:-1], [True]))[: len(a)]
        name[place_b] = 2 * len(self.a_bytes) + b + len(self.b_bytes) * np.concatenate((of_b[1:] != of_b[:-1], [True]))[: len(b)]
        names = self.names.take(pa.array(name))
        starts = np.concatenate(([0], np.cumsum(pc.binary_length(names).to_numpy(zero_copy_only=False))))[np.concatenate(([0], np.cumsum(n_a + n_b)))]
        texts = pa.Array.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(starts.astype(np.int64)), names.buffers()[2]])
        return Aligned(n_a > 0, numbers, texts, np.bincount(stretch, minlength=size), pairs, links)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start, as many as sizes says."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _packed(values: np.ndarray) -> bytes:
    """An array's bytes, compressed, after their number."""
    return struct.pack("<q", values.nbytes) + pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpacked(value: pa.Scalar, kind: str) -> np.ndarray:
    data = value.as_buffer()
    return np.frombuffer(pa.decompress(data[8:], struct.unpack("<q", data[:8])[0], "zstd"), kind).astype(np.int64)


def _chunk(aligner: Aligner, texts: list[str]) -> dict:
    """A chunk's row: the documents' columns; stretch and times (of each document, sizes long); pair and links (of each stretch, widths long); the distinct pairs and how many documents have each."""
    found_in = [aligner.stretches(t) if t else ([], set()) for t in texts]
    cut, alone = [c for c, _ in found_in], set().union(*(x for _, x in found_in))
    coded = pa.array([s for c in cut for s in c], pa.large_string()).dictionary_encode()
    spelled = coded.dictionary
    odd = pc.is_in(spelled, pa.array(list(alone), pa.large_string())).to_numpy(zero_copy_only=False)
    order = np.argsort(odd, kind="stable")  # what can't be encoded together comes last
    found = aligner.align(spelled.take(pa.array(order)), len(order) - int(odd.sum()))
    renamed = np.empty(len(order), np.int64)
    renamed[order] = np.arange(len(order))
    codes = renamed[coded.indices.to_numpy(zero_copy_only=False)]
    lengths = np.array([len(c) for c in cut], np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    bad = lengths == 0
    bad[doc[~found.whole[codes]]] = True
    good = ~bad[doc]
    totals = np.stack([_sums(doc[good], found.numbers[codes[good], k], len(texts)) for k in range(4)], axis=1)
    said = found.texts.take(pa.array(codes[good]))
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(said).to_numpy(zero_copy_only=False))))[np.concatenate(([0], np.cumsum(np.where(bad, 0, lengths))))].tolist()
    body = memoryview(said.buffers()[2] or b"")
    sha = ["" if a == b else hashlib.sha256(body[a : b - 1]).hexdigest() for a, b in zip(ends, ends[1:])]
    size = max(1, len(spelled))
    keys, times = np.unique(doc[good] * size + codes[good], return_counts=True)
    owner, stretch = keys // size, keys % size
    pairs, pair = np.unique(found.pairs, return_inverse=True)
    each = np.repeat(owner, found.widths[stretch]) * max(1, len(pairs)) + pair[_ragged((np.cumsum(found.widths) - found.widths)[stretch], found.widths[stretch])]
    holders = np.bincount(np.unique(each) % max(1, len(pairs)), minlength=len(pairs))
    small = lambda x: _packed(x.astype("<u4"))
    return {
        **{name: totals[:, k] for k, (name, _) in enumerate(_ROW)},
        "sha": sha,
        "sizes": small(np.bincount(owner, minlength=len(texts))),
        "stretch": small(stretch),
        "times": small(times),
        "widths": small(found.widths),
        "pair": small(pair),
        "links": _packed(found.links.astype("<i8")),
        "pairs": _packed(pairs.astype("<i8")),
        "holders": small(holders),
    }


def chunks(docs: DataFrame, a_path: str, b_path: str, doc_id: str, text: str) -> DataFrame:
    """chunk, doc_ids and what _chunk() says, one row for AT_ONCE bytes of text (one text at least)."""
    key = docs.schema[doc_id].dataType
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n, _ in _ROW]
    packed = ("sizes", "stretch", "times", "widths", "pair", "links", "pairs", "holders")
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("doc_ids", T.ArrayType(key)), *lists, T.StructField("sha", T.ArrayType(T.StringType())), *(T.StructField(n, T.BinaryType()) for n in packed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, number = held(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path)), TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            total, at = np.cumsum(sizes), 0
            while at < len(batch):
                until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE)))
                row = _chunk(aligner, batch.column(1)[at:until].to_pylist())
                ids = batch.column(0)[at:until]
                one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | number], pa.int64()), one(ids, None), *(one(row[n], t) for n, t in _ROW), one(row["sha"], pa.string()), *(pa.array([row[n]], pa.binary()) for n in packed)],
                    names=schema.names,
                )
                at, number = until, number + 1

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), run, schema)


def _held_pairs(rows: DataFrame) -> DataFrame:
    """chunk, place, a, b, documents: each chunk's distinct pairs, numbered by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for chunk, pairs, holders in zip(*batch.columns, strict=True):
                p, n = _unpacked(pairs, "<i8"), _unpacked(holders, "<u4")
                if len(p):
                    columns = [np.full(len(p), chunk.as_py()), np.arange(len(p), dtype=np.int32), (p >> 32).astype(np.int32), (p & 0xFFFFFFFF).astype(np.int32), n]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chunk", "place", "a", "b", "documents"])

    return map_texts(rows.select("chunk", "pairs", "holders"), run, "chunk long, place int, a int, b int, documents long").where("documents > 0")


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, documents (how many hold the pair linked) and best (whether no other b has more with that a), from the rows of chunks()."""
    counts, _ = materialize(_held_pairs(rows).groupBy("a", "b").agg(F.sum("documents").alias("documents")), "counts")
    most = counts.groupBy(F.col("a").alias("_a")).agg(F.max("documents").alias("_most"))
    return counts.join(most.hint("merge"), F.col("a") == F.col("_a")).select("a", "b", "documents", (F.col("documents") == F.col("_most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents' alignments and the corpus's pairs.

    First doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row: A encodes a space and the
    text, B the text, to which it adds that space itself. A link's count is how many documents hold its pair of ids;
    n_best counts the links whose count is their A id's highest, ties included, count_sum adds up all links' counts, and
    groups_sha256 is of `a1,a2|b1;a3|b2,b3`, the ids by group. Then pair_counts().

    Special tokens' strings are plain text. A text that is null or empty, or whose tokens' bytes differ from space and
    text, has no tokens: zeros and ''. Null ids are ids like others, rows that repeat an id or a text are documents of
    their own; other columns are ignored; no rows give none.
    """
    rows, _ = materialize(chunks(docs, a_path, b_path, doc_id, text), "chunks")
    known, _ = materialize(pair_counts(rows), "pairs")
    each = _held_pairs(rows).select("chunk", "place", "a", "b")
    joined = each.join(known.hint("merge"), ["a", "b"]).groupBy("chunk").agg(F.collect_list(F.struct("place", "documents", "best")).alias("known"))  # a chunk's pairs
    whole = rows.drop("pairs").join(joined.hint("merge"), "chunk", "left")
    key = rows.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", key), *(T.StructField(n, T.LongType()) for n in (*(n for n, _ in _ROW), "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for k in range(len(batch)):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                sizes, stretch, times, widths, pair, holders = (_unpacked(row[n], "<u4") for n in ("sizes", "stretch", "times", "widths", "pair", "holders"))
                links = _unpacked(row["links"], "<i8")
                count, best = np.zeros(len(holders), np.int64), np.zeros(len(holders), np.int64)
                if row["known"].is_valid:
                    found = row["known"].values
                    place = found.field("place").to_numpy()
                    count[place], best[place] = found.field("documents").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(widths)), widths)
                sums = [_sums(owner, links * x[pair], len(widths)) for x in (best, count)]
                docs_of = np.repeat(np.arange(len(sizes)), sizes)
                both = [pa.array(_sums(docs_of, times * x[stretch], len(sizes))) for x in sums]
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, *(row[n].values for n, _ in _ROW), *both, row["sha"].values], names=schema.names)

    return map_texts(whole, run, schema), known


def _sums(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums by ascending keys."""
    out = np.zeros(n, np.int64)
    if len(keys):
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        out[keys[starts]] = np.add.reduceat(values, starts)
    return out
