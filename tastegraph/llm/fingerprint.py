"""Context-triggered piecewise hashing of texts, and likeness by edit distance.

A rolling hash of the last seven bytes triggers chunk boundaries: at block size 2**k a boundary follows each byte whose
(mixed) rolling hash ends in k zero bits. Each chunk gives one character (six bits of its hash), so an edit changes the characters of the chunks
that it touches. Chunks have 2**k / 4 bytes at least and 4 * 2**k at most, so that passages that repeat a word or line again and again, which trigger
everywhere or nowhere, have signatures in proportion as well. k follows from the text's length, so that about USUAL chunks are expected at most, and is
raised while there are more than LENGTH; the signature at k + 1 is kept too, so that texts of neighbouring block sizes compare.

    fingerprint = "k:signature at k:signature at k + 1"

Likeness is 1 - edit distance / longer length, the best over common block sizes; 0 if there is none, 1 for equal fingerprints.
Edit distances run bit-parallel (Myers) over many pairs at once: a signature has at most 64 characters, one machine word.

``edited`` pairs each text with the next one by id without a global sort in one task: ids are dealt into ranges of about equal characters (percentiles of ids
weighted by length, from a slim table of ids, hashes and lengths), an id that fills several ranges is parted by its texts' hashes, the first row of each
range also goes to the range before it, and each range is read in order in bounded memory. One shuffle of the texts, one range to a task.

Defined cases: null is as empty; an empty text's fingerprint is ``0::``; rows with equal ids are ordered by a hash of their text, then by text; a null id sorts
first; the last row's next is the first of all (a single row's next is itself); in an empty table the result is empty; extra columns are ignored by ``edited``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .frames import bounded, checkpointed, position, with_arrays

U = np.uint64
LENGTH, USUAL, SPAN = 64, 56, 7
#: Characters of the texts that are compared at once.
FLUSH = 4 << 20
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ROLL = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64)


def _levels(data: np.ndarray) -> np.ndarray:
    """How many zero bits the mixed rolling hash ends in after each byte (one text: the hash starts empty)."""
    v = _ROLL[data]
    h = v.copy()
    for back in range(1, SPAN):
        h[back:] += v[:-back] * U(pow(0x9E3779B97F4A7C15, back, 2**64))
    low = W.mix(h) & (~W.mix(h) + U(1))
    return np.where(low == 0, 64, np.log2(np.maximum(low, U(1)).astype(np.float64))).astype(np.int8)


def _cuts(triggers: list[int], k: int, n: int) -> list[int]:
    """Ends of the chunks at block size 2**k, cut at ``triggers`` (ascending) within the least and largest size; the list ends early beyond LENGTH."""
    least, most = max(1, 1 << k >> 2), 4 << k
    cuts, last = [], 0
    while last < n and len(cuts) <= LENGTH:
        i = bisect_left(triggers, last + least)
        last = triggers[i] if i < len(triggers) and triggers[i] <= last + most else min(last + most, n)
        cuts.append(last)
    return cuts


def _signature(cuts: list[int], sums: np.ndarray) -> str:
    """One character for each chunk; sums: prefix sums of position-weighted bytes."""
    ends = np.array(cuts)
    starts = np.concatenate([[0], ends[:-1]])
    h = W.mix((sums[ends] - sums[starts]) * W._INV[starts % W.BLOCK] + (ends - starts).astype(np.uint64))
    return _CHARS[(h >> U(58)).astype(np.int64)].tobytes().decode()


def _prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums in which a chunk's sum, scaled back by its start, depends on its bytes only (chunks beyond BLOCK: on phase too)."""
    W._grow(W.BLOCK)
    n = len(data)
    power = W._POW[np.arange(n) % W.BLOCK] if n > W.BLOCK else W._POW[:n]
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_ROLL[data] * power, out=sums[1:])
    return sums


def fingerprint(data: np.ndarray) -> str:
    """Of one text's UTF-8 bytes."""
    n = len(data)
    if not n:
        return "0::"
    levels = _levels(data)
    marked = np.flatnonzero(levels)  # most bytes trigger at k = 0 only
    sums = _prefix(data)
    k = max(0, (n - 1) // USUAL).bit_length()
    at = lambda k: _cuts((marked[levels[marked] >= k] + 1).tolist() if k else list(range(1, n + 1)), k, n)
    own = at(k)
    while len(own) > LENGTH:
        k, own = k + 1, at(k + 1)
    return f"{k}:{_signature(own, sums)}:{_signature(at(k + 1), sums)}"


def fingerprints(column: pa.Array) -> list[str]:
    data, at = W.buffers(W.texts(column))
    return [fingerprint(data[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of pairs of non-empty strings of at most 64 ASCII characters."""
    out, size = np.zeros(len(a), np.int64), 4096
    for lo in range(0, len(a), size):
        x, y = a[lo : lo + size], b[lo : lo + size]
        rows, m = np.arange(len(x)), np.array([len(s) for s in x])
        table = np.zeros((len(x), 128), np.uint64)
        pad = np.zeros((2, len(x), 64), np.uint8)
        for side, strings in enumerate((x, y)):
            joined = np.frombuffer("".join(strings).encode(), np.uint8)
            n = np.array([len(s) for s in strings])
            row = np.repeat(rows, n)
            pad[side, row, np.arange(len(joined)) - np.repeat(np.cumsum(n) - n, n)] = joined
        for j in range(m.max(initial=0)):
            live = m > j
            table[rows[live], pad[0, live, j]] |= U(1) << U(j)
        n = np.array([len(s) for s in y])
        top = U(1) << (m - 1).astype(np.uint64)
        vp, vn, score = np.full(len(x), ~U(0)), np.zeros(len(x), np.uint64), m.copy()
        for j in range(n.max(initial=0)):
            eq = table[rows, pad[1, :, j]]
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            live = n > j
            score += np.where(live, ((hp & top) != 0).astype(np.int64) - ((hn & top) != 0), 0)
            hp, hn = (hp << U(1)) | U(1), hn << U(1)
            vp, vn = hn | ~(d0 | hp), hp & d0
        out[lo : lo + size] = score
    return out


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """From 0 to 1 for pairs of fingerprints."""
    best = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
    row, left, right = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            continue
        (k, p, q), (m, r, s) = x.split(":"), y.split(":")
        for u, v, common in ((p, r, k == m), (q, s, k == m), (q, r, int(k) + 1 == int(m)), (p, s, int(k) == int(m) + 1)):
            if common and u and v:
                row.append(i)
                left.append(u)
                right.append(v)
    if row:
        far = distances(left, right)
        np.maximum.at(best, np.array(row), 1 - far / np.array([max(len(u), len(v)) for u, v in zip(left, right, strict=True)]))
    return best


def annotate(docs: DataFrame, text_column: str = "text", output: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text: one pass, no shuffle."""
    at = position(docs, text_column)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        for batch in batches:
            yield batch, {output: pa.array(fingerprints(batch.column(at)), pa.string())}

    return with_arrays(docs, [T.StructField(output, T.StringType())], compute)


def edit(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first characters of the following text, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = T.StructType(
    [
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


#: Characters of a range, about, and the most ranges (beyond that they grow; a range is read in a stream).
RANGE_CHARS, MAX_RANGES = 32 << 20, 20_000
_NULL_ID = -(2**63)


def _at_most(marks: np.ndarray, key: Column) -> Column:
    """How many of the ascending marks are no greater than the key: among every c-th first, then among the c that follow."""
    c = max(1, int(len(marks) ** 0.5))
    count = lambda of: F.size(F.filter(of, lambda m: m <= key))
    block = count(F.lit(marks[::c])) - 1
    return F.when(block < 0, F.lit(0)).otherwise(block * c + count(F.slice(F.lit(marks), block * c + 1, F.lit(c))))


def ranges_of(slim: DataFrame, least: int) -> tuple[int, Column]:
    """(number of ranges, range of a row) for rows (key, order, size): in order of (key, order), about equal sums of size."""
    total, rows = slim.agg(F.sum("size"), F.count(F.lit(1))).first()
    n = min(max(least, -(-int(total or 0) // RANGE_CHARS)), MAX_RANGES)
    if n < 2 or not rows:
        return 1, F.lit(0)
    often = slim.select("key", F.explode(F.sequence(F.lit(1), F.ceil(F.col("size") * F.lit(rows / max(total, 1))).cast("int"))))  # at most twice the rows
    found = np.array(often.agg(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("at")).first()["at"], np.int64)
    marks, times = np.unique(found, return_counts=True)
    base = np.cumsum(times) - times + 1  # range 0 is before the first mark
    at = _at_most(marks, F.col("key")) - 1
    of = lambda x: F.get(F.lit(x.astype(np.int64)), at)
    part = F.least(F.floor(F.col("order") / F.lit(2.0**63) * of(times)), of(times) - 1)
    return n, F.when(at < 0, F.lit(0)).otherwise(of(base) + F.when(F.col("key") == of(marks), part).otherwise(of(times) - 1)).cast("int")


def edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranges: int | None = None) -> DataFrame:
    """id and RESULT for each row: its fingerprint, that of its edited text, and both likenesses. ``ranges``: at least so many."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce("id", F.lit(_NULL_ID)), "order": F.shiftrightunsigned(F.xxhash64("text"), 1)})
    slim = checkpointed(rows.select("key", "order", (F.length("text") + 64).cast("long").alias("size")))
    n, place = ranges_of(slim, ranges or spark.sparkContext.defaultParallelism)
    firsts = {r["range"]: r["first"] for r in slim.groupBy(place.alias("range")).agg(F.min(F.struct("key", "order")).alias("first")).collect()}  # at most n
    used = sorted(firsts)  # the ranges that have rows, in order
    if not used:
        return spark.createDataFrame([], T.StructType([T.StructField(id_column, T.LongType()), *RESULT]))
    first_key, first_order, before = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
    for i, r in enumerate(used):
        first_key[r], first_order[r] = firsts[r]
        before[r] = used[i - 1]  # the first range's first row also ends the last range
    of = lambda x: F.get(F.lit(x), F.col("range"))
    # Every row with a range's first id and hash goes along, so that its first by text is among them.
    copy = lambda part, extra: F.struct(part.cast("int").alias("part"), F.lit(extra).alias("extra"))
    is_first = (F.col("key") == of(first_key)) & (F.col("order") == of(first_order))
    copies = F.when(is_first, F.array(copy(F.col("range"), 0), copy(of(before), 1))).otherwise(F.array(copy(F.col("range"), 0)))
    spread = rows.withColumn("range", place).select("id", "text", "key", "order", F.explode(copies).alias("c"))
    ordered = spread.select("id", "text", "c.part", "c.extra", "key", "order").repartitionById(n, "part").sortWithinPartitions("part", "extra", "key", "order", "text").select("id", "text", "part", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list, these: list[str], following: list[str]) -> pa.RecordBatch:
            changed = [edit(t, f) for t, f in zip(these, following, strict=True)]
            own, after, new = (fingerprints(pa.array(x, pa.large_string())) for x in (these, following, changed))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in these], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                    pa.array(own, pa.string()),
                    pa.array(new, pa.string()),
                    pa.array(likeness(own, new), pa.float64()),
                    pa.array(likeness(own, after), pa.float64()),
                ],
                [id_column, *RESULT.names],
            )

        pending: tuple | None = None  # the last row of the range in progress
        ids, these, following, size = [], [], [], 0
        for batch in batches:
            for doc, text, part, extra in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if pending and pending[2] == part:
                    ids.append(pending[0])
                    these.append(pending[1])
                    following.append(text)
                    size += len(text)
                pending = None if extra else (doc, text, part)
                if size > FLUSH or len(ids) >= 2048:
                    yield flush(ids, these, following)
                    ids, these, following, size = [], [], [], 0
        if ids:
            yield flush(ids, these, following)

    return bounded(ordered).mapInArrow(run, T.StructType([T.StructField(id_column, T.LongType()), *RESULT]))
