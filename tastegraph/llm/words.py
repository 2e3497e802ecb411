"""Vectorised word hashing over Arrow text columns.

The operators that read every word of every text share this kernel. It works on
the UTF-8 buffer of an Arrow column with NumPy, without a Python loop over words:
a table look-up marks word bytes, a prefix sum over ``value[byte] * P**position``
gives the polynomial hash (modulo 2**64) of any byte range from two look-ups, and
word boundaries come from the mask's edges.

Memory is bounded: texts are taken in chunks of about CHUNK bytes (one text at
least) and hashed in blocks of BLOCK bytes that are cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
BLOCK = 256 << 10

_P = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _INV = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _POW, _INV
    if n > len(_POW):
        _POW, _INV = _powers(_P, n), _powers(pow(_P, -1, 2**64), n)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Alphabet:
    """Which bytes belong to words, and the value that each contributes.

    ``separators``: bytes between words. A-Z hash as a-z when ``fold`` is set.
    """

    def __init__(self, separators: bytes, fold: bool = True):
        self.word = np.ones(256, bool)
        self.word[list(separators)] = False
        self.values = _VALUES.copy()
        if fold:
            self.values[65:91] = self.values[97:123]


#: Words ``[^\x20\x09-\x0D]+`` with A-Z folded.
SPACED = Alphabet(bytes([32, *range(9, 14)]))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after folding A-Z (so A-Z are word bytes).
ALNUM = Alphabet(bytes(x for x in range(128) if not chr(x).isalnum()))


@dataclass
class Words:
    """Words of a chunk of texts, in order.

    bounds: words of text d are ``[bounds[d], bounds[d + 1])``.
    stems: a row for each prefix length that was asked for, with the hash of so many first bytes of each word (0: the word is shorter).
    """

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    stems: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As one string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the len + 1 offsets of a string array."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row exclusive, bytes, offsets from 0) of row ranges of about ``limit`` bytes."""
    column = texts(column)
    data, at = buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(at, at[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def split(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet = SPACED, stems: tuple[int, ...] = ()) -> Words:
    """All words of the texts that lie one after another in ``data``; ``stems``: lengths of prefixes to be hashed as well, in bytes."""
    cut = offsets[1:-1]  # texts that start inside: no word crosses these
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    prefixes: list[np.ndarray] = []
    at, size = 0, len(data)
    while at < size:
        end = min(at + BLOCK, size)
        while end < size and alphabet.word[data[end - 1]] and alphabet.word[data[end]]:  # cut between words
            ahead = alphabet.word[data[end : end + BLOCK]]
            end += len(ahead) if ahead.all() else int(np.argmin(ahead))
        block = data[at:end]
        word = alphabet.word[block]
        edge = np.empty(len(word) + 1, bool)
        edge[0], edge[-1] = word[0], word[-1]
        np.not_equal(word[1:], word[:-1], out=edge[1:-1])
        inner = cut[np.searchsorted(cut, at, "right") : np.searchsorted(cut, end, "left")] - at
        inner = inner[word[inner] & word[inner - 1]]  # a word ends and another starts here
        ends_at = np.flatnonzero(edge)
        starts, ends = ends_at[0::2], ends_at[1::2]
        if len(inner):
            inner = np.unique(inner)
            starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        _grow(len(block) + 1)
        sums = np.empty(len(block) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(alphabet.values[block] * _POW[: len(block)], out=sums[1:])
        parts.append(((sums[ends] - sums[starts]) * _INV[starts] + (ends - starts).astype(np.uint64), starts + at, ends + at))
        if stems:
            prefixes.append(np.stack([np.where(ends - starts >= k, mix((sums[np.minimum(starts + k, ends)] - sums[starts]) * _INV[starts] + U(k)), U(0)) for k in stems]))
        at = end
    if parts:
        hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        hashes, starts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.concatenate(prefixes, 1) if prefixes else np.zeros((len(stems), 0), np.uint64)
    return Words(mix(hashes), starts, ends, np.searchsorted(starts, offsets, "left"), found)


_M = U(0xD6E8FEB86659FD93)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive hashes (not finalised with mix; len - n + 1 of them)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= _M
        out += hashes[k : len(hashes) - n + 1 + k]
    return out
