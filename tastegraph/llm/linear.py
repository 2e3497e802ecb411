"""Features of the two hashed linear classifiers (toxicity, quality), and their scoring.

Both read whole texts with the vectorised kernel in :mod:`words`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import words as W
from .ftrl import Ftrl, Model, sigmoid

U = np.uint64

#: Toxicity: what a text says often is more evidence than what it says once, so values are log2(1 + occurrences); in texts of more than USUAL_WORDS
#: words occurrences count in proportion, else any common word of a very long text would weigh more than a word of abuse.
USUAL_WORDS = 300
#: The best of 36 settings (values and rates) in four-fold cross-validation inside the learning rows of sf0.1.
TOXIC = Ftrl(bits=22, alpha=0.3, beta=1.0, l1=4.0, l2=0.1, steps=30_000)
#: Quality: shares of n-grams, so that long and short texts compare.
QUALITY = Ftrl(bits=20, alpha=0.5, beta=1.0, l1=0.5, l2=0.5)


def _slots(hashes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (W.mix(hashes ^ U(salt * 0x9E3779B97F4A7C15 % 2**64)) >> U(64 - bits)).astype(np.int64)


#: Lengths in bytes of the word beginnings that count besides whole words: an insult that takes endings is one stem.
STEMS = (4, 5, 6, 7)


def _toxic_slots(words: W.Words, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, text of each) for words and their stems, pairs of neighbours, and pairs with one word skipped."""
    h, text = words.hashes, words.text_of()
    yield _slots(h, 1, bits), text
    for k, stem in zip(STEMS, words.stems, strict=True):
        long = np.flatnonzero(stem)
        yield _slots(stem[long], 8 + k, bits), text[long]
    for gap, salt in ((1, 2), (2, 3)):
        inside = text[gap:] == text[:-gap] if len(h) > gap else np.zeros(0, bool)
        pair = h[:-gap] * U(0xD6E8FEB86659FD93) + h[gap:] if len(h) > gap else h[:0]
        yield _slots(pair[inside], salt, bits), text[gap:][inside]


def _toxic_values(count: np.ndarray, text: np.ndarray, words: W.Words) -> np.ndarray:
    return np.log2(1 + count * np.minimum(1, USUAL_WORDS / np.maximum(np.diff(words.bounds), 1))[text])


def toxic_features(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct slots of each text with their values, for training."""
    for lo, hi, data, offsets in W.chunks(column):
        words = W.split(data, offsets, W.ALNUM, STEMS)
        found = list(_toxic_slots(words, bits))
        slots, text = (np.concatenate(x) for x in zip(*found, strict=True))
        keys, count = np.unique(text << bits | slots, return_counts=True)
        value = _toxic_values(count, keys >> bits, words)
        at = np.searchsorted(keys, np.arange(hi - lo + 1) << bits)
        for d in range(hi - lo):
            yield keys[at[d] : at[d + 1]] & ((1 << bits) - 1), value[at[d] : at[d + 1]]


def toxic_scores(column: pa.Array, model: Model) -> np.ndarray:
    """Only slots with a weight are counted, so most words cost one look-up each."""
    out = []
    for lo, hi, data, offsets in W.chunks(column):
        keys, words = [], W.split(data, offsets, W.ALNUM, STEMS)
        for slots, text in _toxic_slots(words, model.bits):
            hit = np.flatnonzero(model.dense[slots])
            keys.append(text[hit] << model.bits | slots[hit])
        keys, count = np.unique(np.concatenate(keys), return_counts=True)
        total = np.bincount(keys >> model.bits, model.dense[keys & ((1 << model.bits) - 1)] * _toxic_values(count, keys >> model.bits, words), hi - lo)
        out.append(sigmoid(total + model.bias))
    return np.concatenate(out) if out else np.zeros(0)


#: Letters to one class each by case, digits to another; other bytes stay.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def _shaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of classes, runs collapsed: ``EUX!! le`` becomes ``A! a``."""
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    np.not_equal(shape[1:], shape[:-1], out=keep[1:])
    first = offsets[:-1]
    keep[first[first < len(keep)]] = True
    moved = np.zeros(len(shape) + 1, np.int64)
    np.cumsum(keep, out=moved[1:])
    return shape[keep], moved[offsets]


def quality_parts(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slots, text of each, value of each), one entry for each occurrence of an n-gram.

    Streams: words and word pairs; 1-, 2- and 3-grams of shape words; and the share of repeated word
    4-grams and the number of words, each as one hashed token of a coarse bucket.
    An n-gram's values in a text sum to its share of the stream.
    """
    texts = len(offsets) - 1
    parts = []
    words = W.split(data, offsets, W.ALNUM)
    shapes = W.split(*_shaped(data, offsets), W.Alphabet(bytes([32, *range(9, 14)]), fold=False))
    for stream, (tokens, orders) in enumerate(((words, (1, 2)), (shapes, (1, 2, 3)))):
        for n in orders:
            text = tokens.text_of()
            g = W.grams(tokens.hashes, n)
            inside = text[: len(g)] == text[n - 1 :] if len(g) else np.zeros(0, bool)
            at = text[: len(g)][inside]
            count = np.bincount(at, minlength=texts)
            parts.append((_slots(g[inside], 16 + 8 * stream + n, bits), at, 1.0 / np.maximum(count, 1)[at]))
    g, text = W.grams(words.hashes, 4), words.text_of()
    inside = text[: len(g)] == text[3:] if len(g) else np.zeros(0, bool)
    at, keys = text[: len(g)][inside], W.mix(g[inside])
    total = np.bincount(at, minlength=texts)
    distinct = np.bincount((np.unique((at.astype(U) << U(44)) | (keys >> U(20))) >> U(44)).astype(np.int64), minlength=texts)
    repeated = np.floor(10 * (1 - distinct / np.maximum(total, 1)) * (total > 0)).astype(U)
    length = np.ceil(np.log2(np.diff(words.bounds) + 1)).astype(U)
    every = np.arange(texts)
    parts.append((_slots(repeated, 40, bits), every, np.ones(texts)))
    parts.append((_slots(length, 41, bits), every, np.ones(texts)))
    return parts


def quality_features(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in W.chunks(column):
        slots, text, value = (np.concatenate(x) for x in zip(*quality_parts(data, offsets, bits), strict=True))
        keys, back = np.unique(text << bits | slots, return_inverse=True)
        value = np.bincount(back, value, len(keys))
        at = np.searchsorted(keys, np.arange(hi - lo + 1) << bits)
        for d in range(hi - lo):
            yield keys[at[d] : at[d + 1]] & ((1 << bits) - 1), value[at[d] : at[d + 1]]


def quality_scores(column: pa.Array, model: Model) -> np.ndarray:
    out = []
    for lo, hi, data, offsets in W.chunks(column):
        total = np.full(hi - lo, model.bias)
        for slots, text, value in quality_parts(data, offsets, model.bits):
            total += np.bincount(text, model.dense[slots] * value, hi - lo)
        out.append(sigmoid(total))
    return np.concatenate(out) if out else np.zeros(0)
