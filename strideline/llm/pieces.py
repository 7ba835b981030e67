"""SentencePiece BPE encoding and decoding by a prefix table.

Every prefix of a text has one encoding, so it has one last token. Reading left to right, an automaton names the
vocabulary tokens that end at a place; the last token there is the one that forms a compatible pair with the last token
of the prefix before it (a pair is compatible when merging the two tokens' symbols gives the pair back). The ids are
recovered backwards from the last place. The table works on whole texts of any length; since no token of such a
vocabulary has a word mark after another symbol, a text is the sequence of its marked words, and a worker keeps what it
has found for a word. The tables of the short words that a worker does not know yet are filled together, place by place,
on arrays.

The model file is read through the sentencepiece library (pieces, scores, kinds), and the results equal that library's.
Its normaliser must be the identity with a dummy prefix, which __init__ checks.
"""

from __future__ import annotations

import codecs
import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.common import Memory, held, map_texts

MARK = "▁"
#: Words that a Python worker remembers at most.
REMEMBERED = 1_000_000
#: Bytes of text that are encoded at a time, and symbols of words whose tables are filled together.
AT_ONCE = 500_000
TOGETHER = 50_000
#: Symbols of a word that is remembered and whose table is filled with others are fewer.
SHORT = 64
NONE = float("-inf")
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")

codecs.register_error("strideline-bytewise", lambda e: ("�", e.start + 1))


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.end = sp.eos_id()
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        bytes_at = {k: b for b, k in enumerate(self.byte)}
        special = {k for k in range(size) if sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k)}
        self.surface = [sp.id_to_piece(k).replace(MARK, " ") if k not in special else "" for k in range(size)]
        for k, b in bytes_at.items():
            self.surface[k] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.marked = [k not in special and sp.id_to_piece(k).startswith(MARK) for k in range(size)]
        self.surface[sp.unk_id()] = sp.decode([sp.unk_id()])
        self.control = {k for k in range(size) if sp.is_control(k)}
        text = {k: sp.id_to_piece(k) for k in range(size) if k not in special}
        self.score = {p: sp.get_score(k) for k, p in text.items()}
        self.memory = Memory(REMEMBERED)
        self.fits: dict[tuple[str, str], bool] = {}
        self.apart = all(MARK not in p.lstrip(MARK) for p in text.values())
        self.touching = {p[i : i + 2] for p in text.values() for i in range(len(p) - 1)}
        self.edges: dict[str, list[tuple[float, str, str]]] = {}
        self.automaton = ahocorasick.Automaton()
        tokens = {k: p for k, p in text.items() if len(p) == 1 or self._merged(p) == [p]}  # others are never a result
        for k, p in tokens.items():
            self.automaton.add_word(p, (p, k))
        self.automaton.make_automaton()
        self._arrays(tokens, size)
        probe = "Å Å ﬁ\t　x​  y "
        if sp.decode(sp.encode(probe)) != probe or sp.encode(probe)[0] not in (k for k, m in enumerate(self.marked) if m):
            raise ValueError("the model's normaliser is not the identity with a dummy prefix")

    def _arrays(self, tokens: dict[int, str], size: int) -> None:
        """The vocabulary as arrays: symbols that tokens of several hold are numbered from 1, others are 0."""
        numbers = {c: k for k, c in enumerate(sorted({c for pair in self.touching for c in pair}), 1)}
        self.size, self.width = size, len(numbers) + 1
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[[ord(c) for c in numbers]] = list(numbers.values())
        self.alone = np.full(0x110000, -1, np.int32)
        self.touch = np.zeros((self.width, self.width), bool)
        for a, b in self.touching:
            self.touch[numbers[a], numbers[b]] = True
        self.length = np.ones(size + 1, np.int32)  # the last is for symbols without a token
        self.piece = [tokens.get(k, "") for k in range(size)]
        steps: dict[int, int] = {}  # of a tree of beginnings: node * width + symbol, the next node
        ends = {}
        for k, p in tokens.items():
            self.length[k] = len(p)
            if len(p) == 1:
                self.alone[ord(p)] = k
                continue
            node = 0
            for c in p:
                node = steps.setdefault(node * self.width + numbers[c], len(steps) + 1)
            ends[node] = k
        self.ends = np.full(len(steps) + 1, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        self.steps = np.array([*sorted(steps), np.iinfo(np.int64).max], np.int64)
        self.nodes = np.array([steps[k] for k in self.steps[:-1].tolist()] + [0], np.int32)
        second = [(numbers[p[0]], numbers[p[1]], steps[steps[numbers[p[0]]] * self.width + numbers[p[1]]]) for p in tokens.values() if len(p) > 1]
        self.second = np.zeros((self.width, self.width), np.int32)  # the node of two symbols
        for a, b, node in second:
            self.second[a, b] = node
        self.together = all(self.alone[ord(c)] >= 0 for c in numbers)
        self.pairs = np.full(1 << 20, -1, np.int64)  # pair * 2 + whether it is compatible, at the pair's hash

    def _merges(self, piece: str) -> Iterator[tuple[float | None, list[str]]]:
        """A short string's symbols before each merge, with its score (best score first, then leftmost), and those left."""
        symbols, score = list(piece), self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            yield best, symbols
            if best is None:
                return
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _merged(self, piece: str) -> list[str]:
        """The symbols of a short string after merging."""
        for _, symbols in self._merges(piece):
            pass
        return symbols

    def _edges(self, token: str) -> list[tuple[float, str, str]]:
        """A token's merges, each with the first and the last symbol before it."""
        known = self.edges.get(token)
        if known is None:
            known = self.edges[token] = [(NONE if s is None else s, sys.intern(symbols[0]), sys.intern(symbols[-1])) for s, symbols in self._merges(token)]
        return known

    def _fit(self, a: str, b: str) -> bool:
        """Whether b can follow a: merging the symbols of both, the best or else leftmost pair first, never joins a's last to b's first."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > REMEMBERED // 2:
                self.fits.clear()
            known = self.fits[a, b] = a[-1] + b[0] not in self.touching or self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: str, b: str) -> bool:
        lefts, rights, i, j = self._edges(a), self._edges(b), 0, 0
        while True:
            (left, _, x), (right, y, _) = lefts[i], rights[j]
            across = self.score.get(x + y, NONE)
            if left >= across and left >= right and left > NONE:
                i += 1
            elif across >= right and across > NONE:
                return False
            elif right > NONE:
                j += 1
            else:
                return True

    def table(self, text: str) -> list[int]:
        """The ids of a marked text: fills the prefix table, then walks it backwards."""
        n = len(text)
        last: list[tuple[str, int] | None] = [None] * (n + 1)
        fits, fit = self.fits, self._fit
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                p = token[0]
                start = end - len(p)
                if not start:
                    last[end] = token
                    continue
                before = last[start] or (text[start - 1], -1)  # a symbol out of the vocabulary pairs with anything
                ok = fits.get((before[0], p))
                if ok or ok is None and fit(before[0], p):
                    last[end] = token
        ids: list[int] = []
        while n:
            token = last[n]
            if token is None:
                n -= 1
                ids += [self.byte[b] for b in reversed(text[n].encode())]
            else:
                ids.append(token[1])
                n -= len(token[0])
        ids.reverse()
        return ids

    def _word(self, word: str) -> bytes:
        """A marked word's ids; it is cut where no token has the two symbols side by side."""
        parts, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.touching:
                parts.append(word[at:i])
                at = i
        if not at:
            return np.array(self.table(word), "<i4").tobytes()
        known, recall = self.memory.now, self.memory.recall
        out = b""
        for p in (*parts, word[at:]):
            found = known.get(p) or recall(p)
            if found is None:
                found = np.array(self.table(p), "<i4").tobytes()
                if len(p) < SHORT:
                    known[p] = found
            out += found
        return out

    def _tokens(self, symbols: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last places, lengths (ascending) and ids of the tokens of several symbols that stand in a text and reach over no cut."""
        at = np.flatnonzero(~cut[1:])
        node, n, found = self.second[symbols[at], symbols[at + 1]], 2, []
        go = node > 0
        while True:
            at, node = at[go], node[go]
            token = self.ends[node]
            hit = token >= 0
            found.append((at[hit] + n - 1, np.full(np.count_nonzero(hit), n), token[hit]))
            go = ~cut[at + n]
            at, node = at[go], node[go]
            if not len(at):
                break
            key = node.astype(np.int64) * self.width + symbols[at + n]
            place = np.searchsorted(self.steps, key)
            go, node, n = self.steps[place] == key, self.nodes[place], n + 1
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _known(self, pairs: np.ndarray) -> np.ndarray:
        """Slots of pairs (first token * size + second)."""
        return (pairs * 0x9E3779B1 >> 15) & (len(self.pairs) - 1)

    def tables(self, words: list[str]) -> list[bytes]:
        """Each short marked word's ids: the prefix tables of all are filled place by place. Words are cut as _word() does."""
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        until = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        n = len(codes)
        symbols = np.append(self.symbol[codes], 0)
        cut = np.ones(n + 1, bool)
        cut[1:n] = ~self.touch[symbols[: n - 1], symbols[1:n]]
        cut[until] = True
        places = np.arange(n)
        start = np.maximum.accumulate(np.where(cut[:n], places, 0))

        last = self.alone[codes]
        at, length, token = self._tokens(symbols, cut)
        single = np.flatnonzero(~cut[:n])  # at a part's first place there is nothing else
        at, length, token = np.concatenate((single, at)), np.concatenate((np.ones(len(single), np.int64), length)), np.concatenate((last[single], token))
        depth = at - start[at]
        order = np.argsort(depth * n + at, kind="stable")  # a place's tokens from the shortest on
        at, length, token, depth = at[order], length[order], token[order], depth[order]
        bounds = np.searchsorted(depth, np.arange(1, depth[-1] + 2)) if n and len(depth) else []
        longest = np.zeros(n, np.int64)
        for low, high in zip(bounds, bounds[1:]):
            e, size, t = at[low:high], length[low:high], token[low:high]
            first = size > depth[low]  # from the part's start on
            pair = last[np.where(first, e, e - size)].astype(np.int64) * self.size + t
            slot = self.pairs[self._known(pair)]
            known = slot >> 1 == pair
            ok = first | known & (slot & 1 > 0)
            if not (known | first).all():
                best = np.flatnonzero(ok)
                best = best[np.append(e[best][1:] != e[best][:-1], True)] if len(best) else best
                longest[e[best]] = size[best]
                asked = np.flatnonzero(~(known | first) & (size > longest[e]))
                new, back = np.unique(pair[asked], return_inverse=True)
                fits = np.array([self._fit(self.piece[p // self.size], self.piece[p % self.size]) for p in new.tolist()], bool)
                self.pairs[self._known(new)] = new * 2 + fits
                ok[asked] = fits[back]
            best = np.flatnonzero(ok)
            best = best[np.append(e[best][1:] != e[best][:-1], True)]
            last[e[best]] = t[best]

        used = np.zeros(n, bool)
        at = np.flatnonzero(cut[1:])
        least = start[at]
        while len(at):
            used[at] = True
            at = at - self.length[last[at]]
            go = at >= least
            at, least = at[go], least[go]
        ids, count = last[used], used.astype(np.int64)
        if (ids < 0).any():  # symbols without a token are bytes
            lone = used & (last < 0)
            count[lone] = [len(chr(c).encode()) for c in codes[lone].tolist()]
            spelt = np.frombuffer("".join(map(chr, codes[lone].tolist())).encode(), np.uint8)
            out = np.repeat(last[used], count[used])
            out[out < 0] = np.array(self.byte)[spelt]
            ids = out
        ends = np.cumsum(count)[until - 1] * 4
        packed = ids.astype("<i4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of short words."""
        at = size = 0
        for k, w in enumerate(words):
            size += len(w)
            if size >= TOGETHER or k + 1 == len(words):
                some = words[at : k + 1]
                self.memory.now.update(zip(some, self.tables(some), strict=True))
                at, size = k + 1, 0

    def _recalled(self, word: str) -> bytes:
        """The ids of a word that is not among those in use."""
        found = self.memory.recall(word)
        if found is None:
            found = self._word(word)
            if len(word) < SHORT:
                self.memory.now[word] = found
        return found

    def _words(self, text: str) -> list[str]:
        if not self.apart:
            return [MARK + text.replace(" ", MARK)]
        if text[0] == " " or "  " in text or MARK in text:
            return _RUNS.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK)).split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids and the end id as packed little-endian 32-bit integers."""
        self.memory.turn()
        end, known, recall = np.array([self.end], "<i4").tobytes(), self.memory.now, self.memory.recall
        words = [self._words(text) if text else [] for text in texts]
        found = [list(map(known.get, some)) for some in words]
        part = [k for k, ids in enumerate(found) if not all(ids)]
        if self.together:
            new = {w for k in part for w, x in zip(words[k], found[k], strict=True) if x is None}
            self._learn([w for w in new if len(w) < SHORT and recall(w) is None])
        for k in part:
            found[k] = [x or known.get(w) or self._recalled(w) for w, x in zip(words[k], found[k], strict=True)]
        return [b"".join(ids) + end for ids in found]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(): marks are spaces, the first token's leading one goes, byte tokens join to UTF-8 (bytes that don't are U+FFFD each), control tokens give nothing."""
        ids = ids[:-1] if ids and ids[-1] == self.end else ids
        first = next((k for k in ids if k not in self.control), None)
        runs, at = [], 0
        if not self.control.isdisjoint(ids):  # a control token ends a run of byte tokens
            for i, k in enumerate(ids):
                if k in self.control:
                    runs.append(ids[at:i])
                    at = i + 1
        texts = ["".join(map(self.surface.__getitem__, run)) for run in (*runs, ids[at:] if at else ids)]
        out = "".join(t if t.isascii() else t.encode("utf-8", "surrogateescape").decode("utf-8", "strideline-bytewise") for t in texts)
        return out[1:] if first is not None and self.marked[first] else out


def _pieces(path: str) -> Pieces:
    """One for each Python worker, which keeps what it has found from task to task."""
    return held(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, model: str, text: str = "text", *, out: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and out: the ids of each whole text with an end id (array of int).

    Null counts as empty, which has the end id alone. No sampling; rows stay one to one, repeated ones too; other
    columns are not read; no rows give none.
    """
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _pieces(model)
        for batch in batches:
            texts = batch.column(len(keep))
            total, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
            while at < len(batch):
                until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE)))
                ids = coder.encode(texts[at:until].to_pylist())
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[at:until] for k in range(len(keep))), column], names=schema.names)
                at = until

    return map_texts(docs.select(*keep, F.col(text).alias("_text")), run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", *, out: str = "decoded") -> DataFrame:
    """encoded with out: the text of each row's ids, as the library decodes them. Null ids give null, none the empty text. A column named out before is replaced, ids too if it is that."""
    rows = encoded if out == ids else encoded.drop(out)
    place = rows.columns.index(ids)
    rest = [k for k, c in enumerate(rows.columns) if c != out]
    schema = T.StructType([*(rows.schema[k] for k in rest), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _pieces(model)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [None if x.values is None else coder.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in part.column(place)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), pa.array(texts, pa.string())], names=schema.names)

    return map_texts(rows, run, schema)
