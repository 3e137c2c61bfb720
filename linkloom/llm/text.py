"""Vectorised text primitives over Arrow string columns, shared by the operators of this subpackage.

Texts are handled as UTF-8 bytes, a slice of documents at a time, so that a numpy temporary stays near the size of the
CPU's caches whatever the batch holds. A null text is handled as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []

SPACES = b" \t\n\r\x0b\x0c"


class Slice(NamedTuple):
    """Documents first..first+len(offsets)-2 of a column: their bytes, and where each begins and ends in them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[Slice]:
    """Cut a string column into runs of documents of about ``limit`` bytes; a longer document is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if len(column) == 0:
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        begin, end = offsets[first], offsets[last]
        yield Slice(first, whole[begin:end], (offsets[first : last + 1] - begin).astype(np.int64))
        first = last


def table(members: bytes, other: bool = False) -> np.ndarray:
    """A lookup table by byte: True for ``members`` (False if ``other``)."""
    found = np.full(256, other, bool)
    found[list(members)] = not other
    return found


NOT_SPACE = table(SPACES, other=True)
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters of two UTF-8 bytes; all other bytes stay."""
    out = LOWER[data]
    if len(out) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 32
    return out


def tokens(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which ``inside`` holds, never across documents: begins, ends, and per document how
    many tokens lie before it (one more entry than documents)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    within = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = within[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    begins = np.flatnonzero(within & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = within[1:]
    ends_at = offsets[1:] - 1
    after[ends_at[ends_at >= 0]] = False
    ends = np.flatnonzero(within & ~after) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20) + 1
        ups = np.full(size, _BASE)
        ups[0] = 1
        downs = np.full(size, _INVERSE)
        downs[0] = 1
        _powers[:] = [np.multiply.accumulate(ups), np.multiply.accumulate(downs)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums(data: np.ndarray) -> np.ndarray:
    """What ``spans`` needs to hash any spans of ``data``."""
    ups, _ = powers(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ups[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, the same wherever it stands."""
    if len(begins) == 0:
        return np.zeros(0, np.uint64)
    _, downs = powers(len(sums))
    return mix((sums[ends] - sums[begins]) * downs[begins] + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``data``, the same wherever it stands."""
    return spans(sums(data), begins, ends) if len(begins) else np.zeros(0, np.uint64)


def hash_of(word: str | bytes) -> int:
    """The hash that ``hashes`` gives to ``word``."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if len(values) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0]+1, .. (sizes[0] of them), then those of begins[1], and so on."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
