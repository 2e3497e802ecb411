"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits; one binary logistic classifier over hashed byte n-grams of
letters predicts each bit, and decoding takes the codeword with the least logistic loss, bits weighted by
their classifier's accuracy on the training rows. Up to seven languages get the exhaustive code, more a seeded random
code whose least row distance is the best of many draws (one draw beyond some thousands of languages, where distances gather around half). A small gap to the second codeword sets ``ambiguous``.

Every language that occurs is learnt. Fitting takes about ``max_rows`` documents, or LEAST_ROWS for each language if that is more, shared evenly between
languages by a hash of the id (a documented bound; counts come from all rows), in one executor task. The model is a matrix of BUCKETS x bits floats.
Prediction is one pass over whole texts: n-gram counts by bincount, then one matrix product.

Defined cases: null texts, and texts without any letter, are ``und`` with score 0; without training rows everything is
``und``; rows with a null lang are predicted but not learnt from; repeated rows get equal results; columns named like an
output are replaced, others pass through; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import bounded, position, with_arrays
from .words import chunks, texts

BUCKETS = 4096
MAX_ROWS = 4_000
#: Rows of each language at least (as far as there are so many), so that many languages aren't learnt from nothing.
LEAST_ROWS = 8
#: Languages whose counts (a name and a number each) are broadcast at most; with more the rows are joined in another way.
BROADCAST_LANGS = 20_000
#: Lower-cased ASCII letters, bytes of other scripts as they are, everything else 32.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_SEED = np.random.default_rng(11).integers(1, 2**32, (3, 256), dtype=np.uint32) | np.uint32(1)


def profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of square-rooted n-gram shares (n = 1, 2, 3; unit length) for each text."""
    texts_, letters = len(offsets) - 1, _LETTER[data]
    text = np.repeat(np.arange(texts_, dtype=np.int64), np.diff(offsets))
    keep = np.ones(len(letters), bool)  # runs of other bytes count once
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
    letters, text = letters[keep], text[keep]
    counts = np.zeros(texts_ * BUCKETS)
    for n in range(1, 4):
        size = len(letters) - n + 1
        if size <= 0:
            break
        h = np.zeros(size, np.uint32)
        for k in range(n):
            h = (h ^ _SEED[k][letters[k : size + k]]) * np.uint32(0x9E3779B1)
        slot = (h >> np.uint32(32 - 12)).astype(np.int64)
        inside = text[:size] == text[n - 1 :]
        counts += np.bincount((text[:size] * BUCKETS + slot)[inside], minlength=len(counts))
    x = np.sqrt(counts.reshape(texts_, BUCKETS)).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = np.zeros(len(data) + 1, np.int64)
    np.cumsum((_LETTER[data] != 32) & (data < 128), out=ascii_letter[1:])
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for d in np.flatnonzero(~found):
        found[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    return found


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1: exhaustive for up to seven, else random with the best least distance."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        bits = 2 ** (n - 1) - 1
        return np.array([[1.0] * bits] + [[1.0 if (c >> (n - 2 - r)) & 1 else -1.0 for c in range(bits)] for r in range(n - 1)], np.float32)
    rng, bits, best, best_d = np.random.default_rng(5), int(np.ceil(10 * np.log2(n))), None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        code = code[:, np.abs(code.sum(0)) < n]  # each bit must separate something
        if n > 4096:
            return code
        far = (code.shape[1] - code @ code.T) / 2
        if (d := (far + np.eye(n) * 1e9).min()) > best_d:
            best, best_d = code, d
    return best


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 200, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features + 1, bits) by Adam on the logistic loss, rows weighted so that languages count alike; and accuracies."""
    target = code[y]
    share = (1.0 / np.bincount(y, minlength=len(code)).clip(1))[y].astype(np.float32)[:, None] / len(code)
    w = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        margin = x @ w[:-1] + w[-1]
        g = -target * share / (1 + np.exp(np.clip(target * margin, -30, 30)))
        grad = np.concatenate([x.T @ g, g.sum(0, keepdims=True)]) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
    right = (np.sign(x @ w[:-1] + w[-1]) == target).mean(0)
    return w, right.astype(np.float32)


def fit(docs: DataFrame, learn: Column | None = None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, weights, accuracy of each bit). ``learn``: which rows may be used."""
    rows = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    rows = rows.select(F.col(lang_column).alias("_lang"), F.col(text_column).alias("_text"), F.xxhash64(F.col(id_column).cast("string")).alias("_order"))
    counts = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    languages = counts.count()
    share = max(float(max_rows) / max(1, languages), LEAST_ROWS)
    chosen = F.pmod(F.col("_order"), F.lit(1 << 30)) < F.lit(share * (1 << 30)) / F.col("_n")
    if languages <= BROADCAST_LANGS:  # counted just now
        sample = rows.join(F.broadcast(counts), "_lang").where(chosen)
    else:  # names and hashes meet under the language, texts under their hash: no language's texts are one task
        wanted = rows.select("_lang", "_order").join(counts, "_lang").where(chosen).select("_lang", "_order").distinct()
        sample = rows.join(wanted, ["_lang", "_order"])
    sample = sample.select("_lang", "_order", "_text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row.tobytes() for _, _, data, offsets in chunks(batch.column(2)) for row in profiles(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["lang", "ord", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        if not got:
            return
        got.sort(key=lambda x: (x[1], x[0], x[2]))
        langs = sorted({x[0] for x in got})
        number = {x: i for i, x in enumerate(langs)}
        y = np.array([number[x[0]] for x in got])
        w, right = fit_bits(np.stack([np.frombuffer(x[2], np.float32) for x in got]), y, codewords(len(langs)))
        yield pa.RecordBatch.from_arrays([pa.array([langs]), pa.array([w.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], ["langs", "w", "right"])

    model = bounded(sample).mapInArrow(extract, "lang string, ord long, x binary").repartition(1).mapInArrow(train, "langs array<string>, w binary, right binary").toArrow().to_pylist()
    if not model:
        return [], np.zeros((BUCKETS + 1, 1), np.float32), np.ones(1, np.float32)
    right = np.frombuffer(model[0]["right"], np.float32)
    return model[0]["langs"], np.frombuffer(model[0]["w"], np.float32).reshape(BUCKETS + 1, len(right)), right


def decode(margins: np.ndarray, code: np.ndarray, right: np.ndarray, gap: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best row, its share of the softmax of negative losses, whether the second is within ``gap``)."""
    weight = np.maximum(right - 0.5, 1e-3)
    weight = weight / weight.sum() * len(weight)
    loss = np.stack([(weight * np.logaddexp(0, -margins * row)).sum(1) for row in code], 1)
    best = loss.argmin(1)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    top = np.sort(p, 1)
    return best, p.max(1), (top[:, -1] - top[:, -2] < gap) if len(code) > 1 else np.zeros(len(best), bool)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_column: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = position(docs, text_column)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        langs, w, right = shared.value
        code, names = codewords(len(langs)), np.array([*langs, "und"], object)
        for batch in batches:
            got = []
            for _, _, data, offsets in chunks(texts(batch.column(at)), 2 << 20):
                known = lettered(data, offsets) if langs else np.zeros(len(offsets) - 1, bool)
                best, p, close = np.full(len(known), len(langs)), np.zeros(len(known)), np.zeros(len(known), bool)
                for lo in range(0, len(known), 512):  # a dense profile is BUCKETS floats a text
                    part = slice(lo, min(lo + 512, len(known)))
                    x = profiles(data[offsets[lo] : offsets[part.stop]], offsets[lo : part.stop + 1] - offsets[lo])
                    if langs:
                        best[part], p[part], close[part] = decode(x @ w[:-1] + w[-1], code, right)
                got.append((np.where(known, best, len(langs)), np.where(known, p, 0.0), close & known))
            best, p, close = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
            yield batch, {"lang_pred": pa.array(names[best], pa.string()), "score": pa.array(p.astype(float), pa.float64()), "ambiguous": pa.array(close)}

    return with_arrays(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())], compute)
