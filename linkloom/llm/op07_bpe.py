"""Byte-level BPE encoding and decoding with a given vocabulary of ranks.

The bytes of the vocabulary are mapped to Latin-1 characters, so that a pyahocorasick automaton finds all tokens at all
places of a piece of text. Encoding walks the piece from left to right, takes the longest token that is compatible with the
one before, and steps back where no token fits; positions that can't be completed are remembered, so the walk is linear.
Two adjacent tokens are compatible if the merges, applied to their bytes, give just these two; that is decided from the
merge tree and memoised. The result is that of the merges in order of rank.

Pieces (the vocabulary's pattern: contractions, words, numbers, others, white space) are cut for a whole slice of texts at
once, from a class per character. Each distinct piece is encoded once per worker.

A null text has null tokens, an empty one none. Special tokens in a text are ordinary text. Repeated rows are encoded each.
An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import text as tx

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_ENCODED = "doc_id long, n_tokens int, tokens array<int>, round_trip boolean"
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_MOST_CACHED = 1 << 21
_MOST_POOLED = 1 << 23  # tokens
_MOST_PAIRS = 1 << 19
_WINDOW = 1 << 16  # bytes whose candidates are found at a time


def load(path: str = VOCABULARY) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks[k] for k in range(len(ranks))]


@cache
def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
    table[_WHITE] = _SPACE
    return table


def pieces(piece: tx.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Begins of the pieces of a slice of texts, in bytes, and per text how many lie before it (one more than texts)."""
    data, offsets = piece.data, piece.offsets
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    if (data >= 0x80).any():
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        where = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each character
    else:
        chars, where = data, np.arange(n)
    kind = _classes()[chars]
    m = len(kind)
    text = np.zeros(m, bool)  # first character of a text
    heads = np.searchsorted(where, offsets[:-1])
    text[heads[heads < m]] = True
    cut = text.copy()
    cut[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # The last white space before something else stands alone, or goes with what follows if it is a blank.
    last = np.zeros(m, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~text[1:]
    cut |= last
    joined = np.zeros(m, bool)
    joined[1:] = last[:-1] & (chars[:-1] == 32)
    cut &= ~joined
    for q in np.flatnonzero((chars == 39) & cut).tolist():  # contractions
        after = "" if q + 1 == m or text[q + 1] else chr(chars[q + 1]) + ("" if q + 2 == m or text[q + 2] else chr(chars[q + 2]))
        size = 2 if after in ("re", "ve", "ll") else 1 if after[:1] in ("s", "t", "m", "d") else 0
        if size:
            cut[q + 1] = False
            if q + 1 + size < m and not joined[q + 1 + size]:
                cut[q + 1 + size] = True
    begins = where[cut]
    return begins, np.searchsorted(begins, offsets)


class Encoder:
    """Encodes pieces by backtracking. ``tokens``: bytes by rank, all single bytes among them."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.sizes = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.compatible: dict[int, bool] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.known = np.zeros(0, np.uint64)  # codes of pieces in order, and where their tokens are in the pool
        self.spans = np.zeros((0, 2), np.int32)
        self.recent, self.fresh = self.known.copy(), self.spans.copy()  # as these, of the latest pieces
        self.longest = max(self.sizes)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.size_of = np.array(self.sizes, np.int64)
        self.begin_of = np.cumsum(self.size_of) - self.size_of

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens that merge into ``token`` (itself twice, of a single byte): what lower ranks make of its bytes."""
        found = self.halves.get(token)
        if found is None:
            parts = [self.rank[bytes([b])] for b in self.tokens[token]]
            while len(parts) > 2:
                merged = [self.rank.get(self.tokens[a] + self.tokens[b], token) for a, b in zip(parts, parts[1:])]
                best = min(merged)
                if best >= token:
                    break
                k = merged.index(best)
                parts[k : k + 2] = [best]
            found = self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` apart when they stand side by side."""
        pair = left << 32 | right
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= _MOST_PAIRS:
                self.compatible.clear()
            known = self.compatible[pair] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo the merges of both, latest first: a merge across the seam that would have come before one undone so far
        # must not exist.
        bound = len(self.tokens)
        while True:
            across = self.rank.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < bound:
                return False
            if left > right:
                bound = left
                inner = self.split(left)[1]
                if inner != left:
                    left = inner
                    continue
                bound = right + 1
                inner = self.split(right)[0]
                if inner == right:
                    return True
                right = inner
            else:
                bound = right + 1
                inner = self.split(right)[0]
                if inner != right:
                    right = inner
                    continue
                bound = left
                inner = self.split(left)[1]
                if inner == left:
                    return True
                left = inner

    def encode(self, raw: bytes) -> Sequence[int]:
        whole = self.rank.get(raw)
        if whole is not None and self._reachable(whole):
            return [whole]
        sizes, known = self.sizes, self.compatible
        size = len(raw)
        dead = bytearray(size + 1)
        out, turns = array("i"), array("i")  # tokens, and which candidate each was
        pos, turn, last = 0, -2, -1  # -2: the longest
        held: dict[int, list[list[int]]] = {}
        at: list[list[int]] = []
        base = top = 0
        while pos < size:
            if not base <= pos < top:  # candidates lie by blocks, of which the last two are kept
                base = pos // _WINDOW * _WINDOW
                top = min(size, base + _WINDOW)
                if base not in held:
                    if len(held) > 1:
                        del held[next(iter(held))]
                    held[base] = self._candidates(raw, base, top)
                at = held[base]
            own = at[pos - base]
            if turn == -2:
                turn = len(own) - 1
            while turn >= 0:
                token = own[turn]
                if not dead[pos + sizes[token]]:
                    if last < 0:
                        break
                    good = known.get(last << 32 | token)
                    if self.fits(last, token) if good is None else good:
                        break
                turn -= 1
            if turn >= 0:
                out.append(token)
                turns.append(turn)
                pos += sizes[token]
                last = token
                turn = -2
            else:
                dead[pos] = 1
                pos -= sizes[out.pop()]
                turn = turns.pop() - 1
                last = out[-1] if out else -1
        return out.tolist() if size <= _WINDOW else out

    def _candidates(self, raw: bytes, base: int, top: int) -> list[list[int]]:
        """Of each place from base to top, the tokens that begin there, shorter ones first."""
        at: list[list[int]] = [[] for _ in range(top - base)]
        sizes, n = self.sizes, top - base
        for end, token in self.automaton.iter(raw[base : top + self.longest - 1].decode("latin-1")):
            begin = end - sizes[token] + 1
            if begin < n:
                at[begin].append(token)  # by rising end, so by rising length
        return at

    def _reachable(self, token: int) -> bool:
        left, right = self.split(token)
        return left != token or self.sizes[token] == 1

    def ids(self, codes: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size in the pool of the tokens of each piece; equal pieces have equal codes."""
        names, first, back = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.known) + len(self.recent) > _MOST_CACHED or self.used > _MOST_POOLED:
            self.known, self.spans, self.recent, self.fresh, self.used = self.known[:0], self.spans[:0], self.recent[:0], self.fresh[:0], 0
            self.pool = self.pool[: 1 << 16].copy()
        spans = np.zeros((len(names), 2), np.int32)
        left = self._lookup(self.known, self.spans, names, spans, np.arange(len(names)))
        new = self._lookup(self.recent, self.fresh, names, spans, left)
        if len(new):
            whole = memoryview(data)
            found = [self.encode(bytes(whole[a:b])) for a, b in zip(begins[first[new]].tolist(), ends[first[new]].tolist())]
            sizes = np.array([len(x) for x in found], np.int64)
            fresh = np.concatenate([np.asarray(x, np.int32) for x in found])
            if self.used + len(fresh) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(fresh)), np.int32)])
            self.pool[self.used : self.used + len(fresh)] = fresh
            spans[new] = np.stack([self.used + np.cumsum(sizes) - sizes, sizes], axis=1)
            self.used += len(fresh)
            # New pieces gather in a small table, which is merged into the large one when it has a quarter of its size.
            self.recent, self.fresh = self._merged(self.recent, self.fresh, names[new], spans[new])
            if len(self.recent) > max(4096, len(self.known) // 4):
                self.known, self.spans = self._merged(self.known, self.spans, self.recent, self.fresh)
                self.recent, self.fresh = self.recent[:0], self.fresh[:0]
        own = spans[back].astype(np.int64)
        return own[:, 0], own[:, 1]

    @staticmethod
    def _lookup(known: np.ndarray, spans: np.ndarray, names: np.ndarray, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Fill the rows of ``out`` whose name is known; the other rows."""
        if len(known) == 0 or len(rows) == 0:
            return rows
        at = np.minimum(np.searchsorted(known, names[rows]), len(known) - 1)
        hit = known[at] == names[rows]
        out[rows[hit]] = spans[at[hit]]
        return rows[~hit]

    @staticmethod
    def _merged(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = np.concatenate([a, b])
        order = np.argsort(names, kind="stable")
        return names[order], np.concatenate([x, y])[order]

    def encode_slice(self, piece: tx.Slice) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts of a slice, and how many lie before each text (one more than texts)."""
        begins, where = pieces(piece)
        if len(begins) == 0:
            return np.zeros(0, np.int32), np.zeros(piece.count + 1, np.int64)
        ends = np.append(begins[1:], len(piece.data))
        at, size = self.ids(tx.hashes(piece.data, begins, ends), piece.data, begins, ends)
        return self.pool[tx.ragged(at, size)], np.append(0, np.cumsum(size))[where]

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of ``tokens``."""
        return self.bytes[tx.ragged(self.begin_of[tokens], self.size_of[tokens])]


_encoders: dict[int, Encoder] = {}


def _encoder(tokens: list[bytes]) -> Encoder:
    """The worker's encoder of this vocabulary."""
    name = hash(tuple(tokens))
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(tokens)
    return _encoders[name]


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_tokens, tokens, and round_trip: whether they decode to the text's very bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared.value)
        for batch in batches:
            for piece in tx.slices(batch.column(1)):
                there = pc.is_valid(batch.column(1).slice(piece.first, piece.count))
                tokens, where = own.encode_slice(piece)
                back = own.decode(tokens)
                ends = np.append(0, np.cumsum(own.size_of[tokens]))[where]
                if len(back) == len(piece.data) and np.array_equal(ends, piece.offsets):
                    wrong = np.append(0, np.cumsum(back != piece.data))[piece.offsets]
                    good = pa.array(wrong[1:] == wrong[:-1])
                else:
                    good = pa.array([back[ends[k] : ends[k + 1]].tobytes() == piece.data[piece.offsets[k] : piece.offsets[k + 1]].tobytes() for k in range(piece.count)])
                lists = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(tokens))
                columns = [pc.if_else(there, x, pa.scalar(None, x.type)) for x in (pa.array(np.diff(where), pa.int32()), lists, good)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.count), *columns], ["doc_id", "n_tokens", "tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ENCODED)


def decoded(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows of doc_id and tokens. Null tokens have a null text; tokens that aren't in the vocabulary, or
    null, raise; bytes that aren't UTF-8 are replaced by U+FFFD."""
    shared = rows.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared.value)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)).tobytes().decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "doc_id long, text string")
