"""Benchmark decontamination by winnowing.

Words are runs of digits, letters and non-ASCII bytes, A-Z folded. A window is ``WINDOW`` consecutive words of a
benchmark item; an item with fewer words is one window. A document's words inside any occurrence of a window are hit.

Winnowing keeps, from each run of ``WINDOW - K + 1`` k-gram hashes (K = 7), every k-gram with the least hash. A shared span of
WINDOW words holds such a run on both sides with the same hashes, so both sides keep a common k-gram inside it: no shared
span of that length is missed. Kept k-grams of documents meet those of items by hash. Each meeting is extended to both sides: the (at most seven)
document windows around it are looked up among the distinct windows of the benchmark and compared word by word. Items shorter than a window are
found by the hash of their whole word sequence, one pass for each length that occurs.

Nothing is emitted for each pair of places: a document place is looked up once, however often the benchmark has its k-gram. Windows with the same
items share one number for that set, and a text's items come from its distinct numbers, so that a line that all items share and a document repeats
costs its places plus its items, not their product.

Scale: the benchmark is the small side. Its distinct rows are split into blocks of at most ``BLOCK_CHARS`` characters and one item (the proven bound of
what is collected and broadcast at once; an item never spans blocks), and documents make one map-only pass for each block, whole texts, no shuffle. With
more than one block each row carries its hit spans from pass to pass, where they are united (and every CHAIN passes
to the shared checkpoint folder).

Defined cases: null and empty texts have no words and no hits (contaminated false); items without words are ignored; repeated
items count by distinct item_id as text, and repeated rows once; null item ids are ignored in ``items`` but their windows hit; repeated documents are judged row by
row; columns of documents named like an output are replaced, all others pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .frames import checkpointed, position, with_arrays

U = np.uint64
WINDOW, K = 13, 7
BLOCK_CHARS = 8_000_000
_TABLE_BITS = 22


def _least(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """op over each n consecutive values (n <= 8), in log steps."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = op(x[: len(x) - step], x[step:])
        have += step
    return x


def kept(grams: np.ndarray, run: int) -> np.ndarray:
    """Positions of k-grams that are the least of some run (all of them if there are fewer than a run)."""
    if len(grams) < run:
        return np.arange(len(grams))
    least = _least(grams, run, np.minimum)
    pad = np.zeros(run - 1, np.uint64)
    most = _least(np.concatenate([pad, least, pad]), run, np.maximum)
    return np.flatnonzero(most == grams)


def _apart(words: W.Words, salt: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with ``width`` private values after each text's words, and each text's place: no k-gram crosses texts."""
    counts = np.diff(words.bounds)
    place = np.arange(len(counts)) * width + words.bounds[:-1]
    out = W.mix(np.arange(len(words.hashes) + width * len(counts), dtype=np.uint64) + U(salt))
    out[np.arange(len(words.hashes)) + np.repeat(np.arange(len(counts)) * width, counts)] = words.hashes
    return out, place


@dataclass
class Index:
    """Fingerprints and windows of a block of benchmark items, for look-ups from documents."""

    items: list
    window: int
    hashes: np.ndarray  # item words, texts apart
    grams: np.ndarray  # kept k-grams, sorted and distinct
    windows: np.ndarray  # hashes of whole windows, sorted and distinct
    places: np.ndarray  # where each of these windows first begins in ``hashes``
    holders: np.ndarray  # the number of its set of items
    sets: list[np.ndarray]  # number -> items
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # words -> (sorted hashes, numbers of their sets)

    @classmethod
    def of(cls, ids: list, texts: list[str], window: int = WINDOW, k: int = K) -> Index:
        data, at = W.buffers(pa.array(texts, pa.large_string()))
        words = W.split(data, at, W.ALNUM)
        counts = np.diff(words.bounds)
        hashes, place = _apart(words, 1 << 62, window)
        owner = np.full(len(hashes), -1)
        owner[np.arange(len(words.hashes)) + np.repeat(np.arange(len(counts)) * window, counts)] = np.repeat(np.arange(len(counts)), counts)
        numbers: dict[bytes, int] = {}
        sets: list[np.ndarray] = []

        def grouped(keys: np.ndarray, holder: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(distinct keys, first place of each, number of the set of its holders)"""
            order = np.lexsort((holder, keys))
            keys, holder, begin = keys[order], holder[order], begin[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            found = []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=False):
                mine = np.unique(holder[lo:hi])
                if (n := numbers.setdefault(mine.tobytes(), len(sets))) == len(sets):
                    sets.append(mine)
                found.append(n)
            return keys[first], begin[first], np.array(found, np.int64)

        g = W.mix(W.grams(hashes, k))
        at = kept(g, window - k + 1)
        at = at[(owner[at] >= 0) & (owner[at] == owner[at + k - 1])]
        at = at[counts[owner[at]] >= window]
        begin = np.arange(max(0, len(hashes) - window + 1))
        begin = begin[(owner[begin] >= 0) & (owner[begin] == owner[begin + window - 1])]
        windows, places, holders = grouped(_spans(hashes, begin, window), owner[begin], begin)
        short = {}
        for n in sorted({int(c) for c in counts if 0 < c < window}):
            which = np.flatnonzero(counts == n)
            keys, _, held = grouped(_spans(hashes, place[which], n), which, place[which])
            short[n] = (keys, held)
        return cls(ids, window, hashes, np.unique(g[at]), windows, places, holders, sets, short)


def _spans(hashes: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on."""
    out = hashes[begin]
    for j in range(1, n):
        out = out * W._M + hashes[begin + j]
    return W.mix(out)


def _filter(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(keys >> U(64 - _TABLE_BITS)).astype(np.int64)] = True
    return table


def _known(keys: np.ndarray, table: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in keys whose key is sought, its place in the sorted distinct ``sought``)"""
    maybe = np.flatnonzero(table[(keys >> U(64 - _TABLE_BITS)).astype(np.int64)])
    at = np.searchsorted(sought, keys[maybe])
    same = at < len(sought)
    same[same] = sought[at[same]] == keys[maybe[same]]
    return maybe[same], at[same]


class Matcher:
    """An index made ready on a worker."""

    def __init__(self, index: Index, k: int = K):
        self.index, self.k, self.table = index, k, _filter(index.grams)
        self.tables = {n: _filter(h) for n, (h, _) in index.short.items()}

    def hits(self, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, last word exclusive, number of the items' set) of each window; words count from the text's start."""
        index, k, window = self.index, self.k, self.index.window
        hashes, place = _apart(words, 1 << 61, 1)
        found = [tuple(np.zeros(0, np.int64) for _ in range(3))]
        if len(index.grams) and len(hashes) >= window:
            g = W.mix(W.grams(hashes, k))
            at = kept(g, window - k + 1)
            p = at[_known(g[at], self.table, index.grams)[0]]
            begin = np.unique(p[:, None] - np.arange(window - k + 1))
            begin = begin[(begin >= 0) & (begin <= len(hashes) - window)]
            keys = _spans(hashes, begin, window)
            to = np.searchsorted(index.windows, keys)
            same = to < len(index.windows)
            same[same] = index.windows[to[same]] == keys[same]
            begin, to = begin[same], to[same]
            same = np.ones(len(begin), bool)
            for j in range(window):
                same &= hashes[begin + j] == index.hashes[index.places[to] + j]
            found.append((begin[same], begin[same] + window, index.holders[to[same]]))
        if self.tables:
            g, n = hashes.copy(), 1
            while True:
                if n in self.tables:
                    p, q = _known(W.mix(g), self.tables[n], index.short[n][0])
                    found.append((p, p + n, index.short[n][1][q]))
                if n >= max(self.tables) or len(g) < 2:
                    break
                g, n = g[:-1] * W._M + hashes[n:], n + 1
        starts, ends, holders = (np.concatenate(x) for x in zip(*found, strict=True))
        text = np.searchsorted(place, starts, "right") - 1
        return text, starts - place[text], ends - place[text], holders


def blocks(benchmark: DataFrame, id_column: str, text_column: str, block_chars: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(distinct rows with ``part`` and ``block``, the numbers of all blocks); a block has at most ``block_chars`` characters and one item.

    Rows are dealt by hash into as many parts as the characters need, and each part is cut where its running length passes a multiple of the bound, so
    that the sizes are proven in one pass whatever the items are."""
    rows = benchmark.select(F.col(id_column).cast("string").alias("item"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= block_chars:
        return rows.withColumns({"part": F.lit(0), "block": F.lit(0)}), [(0, 0)]
    order = F.xxhash64("item", "text")
    running = Window.partitionBy("part").orderBy("_order", "item", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_order", order).withColumn("part", F.pmod("_order", F.lit(-(-int(total) // block_chars))).cast("int"))
    before = F.sum(F.length("text")).over(running) - F.length("text")
    dealt = checkpointed(rows.withColumn("block", F.floor(before / block_chars).cast("int")).drop("_order"))
    return dealt, sorted((r.part, r.block) for r in dealt.select("part", "block").distinct().collect())


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),
    T.StructField("whole_window", T.BooleanType()),
]


def _pass(docs: DataFrame, shared, text_column: str, prior: bool) -> DataFrame:
    """One block's hits in docs; ``prior``: docs already has FIELDS from other blocks, which are united with these."""
    at = position(docs, text_column)
    had = [position(docs, x) for x in ("item_ids", "hit_spans", "whole_window")] if prior else []

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        index = shared.value
        matcher = Matcher(index)
        for batch in batches:
            n_words, n_hit, items, intervals, whole = [], [], [], [], []
            for lo, hi, data, offsets in W.chunks(batch.column(at)):
                words = W.split(data, offsets, W.ALNUM)
                text, starts, ends, holders = matcher.hits(words)
                own, spans = [set() for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                full = np.zeros(hi - lo, bool)
                full[text[ends - starts == index.window]] = True
                if prior:
                    before = [batch.column(c).slice(lo, hi - lo).to_pylist() for c in had]
                    own = [set(x) for x in before[0]]
                    spans = [list(zip(x[::2], x[1::2], strict=True)) for x in before[1]]
                    full |= np.array(before[2], bool)
                for d, n in np.unique(np.stack([text, holders]), axis=1).T.tolist() if len(text) else []:
                    own[d].update(index.items[i] for i in index.sets[n].tolist() if index.items[i] is not None)
                for d, s, e in zip(*_merged(text, starts, ends), strict=True):
                    spans[d].append((s, e))
                spans = [_united(x) for x in spans]
                n_words += np.diff(words.bounds).tolist()
                n_hit += [sum(e - s for s, e in x) for x in spans]
                items += [sorted(x) for x in own]
                intervals += [[y for x in mine for y in x] for mine in spans]
                whole += full.tolist()
            yield batch, {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "item_ids": pa.array(items, pa.list_(pa.string())), "hit_spans": pa.array(intervals, pa.list_(pa.int64())), "whole_window": pa.array(whole, pa.bool_())}

    return with_arrays(docs, FIELDS, compute)


def _merged(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list, list, list]:
    """(texts, starts, ends) with overlapping and touching spans of a text made one."""
    order = np.lexsort((starts, text))
    text, starts, ends = text[order], starts[order], ends[order]
    if not len(text):
        return [], [], []
    wide = int(ends.max()) + 1  # spans of one text after another on one line, so that a running maximum stays inside its text
    reach = np.maximum.accumulate(ends + text * wide) - text * wide
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (starts[1:] > reach[:-1])])
    last = np.concatenate([np.flatnonzero(new)[1:], [len(text)]]) - 1
    return text[new].tolist(), starts[new].tolist(), reach[last].tolist()


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


#: Passes in one stage before the rows are written to the checkpoint folder.
CHAIN = 4


def find(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted strings), hit_spans (word positions: start, end, start, ...; united) and whole_window (whether WINDOW words
    of an item stand there one after another)."""
    spark = docs.sparkSession
    dealt, numbers = blocks(benchmark, item_column, item_text, block_chars)
    found = docs
    for at, (part, block) in enumerate(numbers):
        rows = dealt.where((F.col("part") == part) & (F.col("block") == block)).select("item", "text").toArrow()
        shared = spark.sparkContext.broadcast(Index.of(rows["item"].to_pylist(), rows["text"].to_pylist()))
        found = _pass(found, shared, text_column, at > 0)
        if at % CHAIN == CHAIN - 1 and at < len(numbers) - 1:
            found = checkpointed(found)
    return found


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least a twentieth of the words, and one at least, is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def brute(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> dict:
    """The same from the definition, slowly: doc_id -> (n_words, n_hit, sorted item ids)."""
    import re

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    windows: dict = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - window + 1)) if w else []:
            windows.setdefault(tuple(w[s : s + window]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if got := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= got
        out[d] = (len(w), len(hit), sorted(found))
    return out


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(item_ids).encode()).hexdigest()
