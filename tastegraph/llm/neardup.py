"""Near-duplicate groups by MinHash with tensored banding, every link confirmed on full shingle sets.

Texts are lower-cased (A-Z), split at ASCII white space and cut into distinct shingles of ``n`` words (shorter texts: the whole
sequence as one). Two documents are linked if ``100 * |A and B| >= percent * |A or B|``; groups are connected components.

1. One pass gives each document its set's size, a 128-bit signature of the set, and 32 minhashes. Equal sets form a class, which
   a grouped minimum reduces to its least doc_id before anything is compared: a third of all rows being copies costs nothing later.
2. Tensored banding: the first 16 minhashes are two collections of 8, and the 64 table keys of a class are the pairs of one from each.
   A pair of likeness s shares no key with probability at most 2 (1 - s)**8: 5e-6 at 0.8, far less above, from 16
   minhashes instead of 128. All 32 give a sketch of 8 bits each; fewer than 13 equal ones exclude likeness 0.8 (3e-7).
3. No bucket emits all its pairs. Every member is paired with its bucket's centre, the member that meets most others over all buckets (grouped
   sums and maxima, combined before the shuffle), so a family of near copies has one centre nearly everywhere. Sizes and sketches sift
   the pairs, and full sets confirm them. Buckets of two are then complete.
4. Families of near copies gather around hubs: a class's hub is the best connected of the centres that it was sifted with (or itself). Where a hub's
   family isn't one component yet (members just too far from the hub may be near one another), its members' sets are compared in blocks of bounded
   size by one matrix product each, which yields only confirmed links between components.
5. What remains in buckets of three or more - members of different components and different hubs - is compared pair by pair under the same
   sieve inside the join (once, in the first bucket that they share), and confirmed. Of a bucket, only the members outside its largest component or hub are
   one side, and a large bucket is dealt into blocks, so that it is neither one task nor all pairs. No candidate pair that could still join two components is left out.
6. Components by large-star and small-star rounds, all distributed.

Texts aren't shuffled where the ids that are sought are some millions at most: a Bloom filter of up to FILTER_BITS picks the texts whose sets are made, and
only those sets meet. Beyond that the filter saturates and sets of most texts are shuffled, which costs about the input once more; results don't change.

Defined cases: null and empty texts, and those of white space only, have no shingles and are linked with nothing; rows of one doc_id are one document: if
their texts differ, these are linked whatever their likeness (each row gets its own size); rows with a null doc_id get a null component and are kept; equal
texts always share a component; extra columns are ignored by ``groups``; ids are below 2**62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .frames import bounded, checkpointed

U = np.uint64
HALF, SKETCH, LEAST_EQUAL = 8, 32, 13
_rng = np.random.default_rng(42)
_A = _rng.integers(1, 2**63, SKETCH, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 2**63, SKETCH, dtype=np.uint64)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one text's word hashes."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    size = min(n, len(hashes))
    return np.unique(W.mix(W.grams(hashes, size) + U(size)))


def minhashes(found: np.ndarray) -> np.ndarray:
    out = np.full(SKETCH, ~U(0))
    for lo in range(0, len(found), 8192):
        np.minimum(out, (found[lo : lo + 8192, None] * _A + _B).min(0), out=out)
    return out


def sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for lo, hi, data, offsets in W.chunks(column):
        words = W.split(data, offsets, W.SPACED)
        for d in range(hi - lo):
            yield shingles(words.hashes[words.bounds[d] : words.bounds[d + 1]], n)


_SKETCH = [f"s{i}" for i in range(4)]  # 32 minhashes of 8 bits
_BANDS = [f"b{i}" for i in range(HALF)]  # the two collections, two minhashes of 32 bits in each
_NAMES = ["doc_id", "node", "many", "n_shingles", "h1", "h2", *_SKETCH, *_BANDS]


def apart(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with ``many``, whether the id has several texts, and ``node``: the id for the text with words and the least hash, for other
    texts of that id (those without words are equal) a number above all ids, from id and text. Null ids: null."""
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    order = F.struct((~worded).alias("none"), F.xxhash64(F.when(worded, F.col("text")).otherwise(F.lit(""))).alias("hash"))
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(order).alias("least"), F.max(order).alias("most")).where("least < most").select("doc_id", "least")
    several = checkpointed(several)
    if several.isEmpty():
        return docs.withColumns({"many": F.lit(False), "node": F.col("doc_id")})
    rows = docs.withColumn("order", order).join(several, "doc_id", "left")
    other = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "order"), F.lit(1 << 62))
    return rows.withColumns({"many": F.col("least").isNotNull(), "node": F.when(F.col("order") > F.col("least"), other).otherwise(F.col("doc_id"))}).drop("order", "least")


def profiles(docs: DataFrame, n: int) -> DataFrame:
    """Of (doc_id, node, many, text): size, signature, sketch and the two collections of minhashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sign, sketch, bands = [], [], [], []
            for found in sets(batch.column(3), n):
                size.append(len(found))
                low = W.mix(found ^ U(0x5851F42D4C957F2D))
                sign.append((int(found.sum(dtype=np.uint64)), int(low.sum(dtype=np.uint64))))
                m = minhashes(found)
                sketch.append((m >> U(24)).astype(np.uint8).view(np.int64))
                bands.append((m[: 2 * HALF] >> U(32)).astype(np.uint32).view(np.int64))
            sign = np.array(sign, np.uint64).reshape(-1, 2).view(np.int64)
            rest = np.concatenate([sign, np.array(sketch, np.int64).reshape(-1, 4), np.array(bands, np.int64).reshape(-1, HALF)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in rest.T)], _NAMES)

    return bounded(docs).mapInArrow(run, ", ".join(f"{x} {'boolean' if x == 'many' else 'long'}" for x in _NAMES))


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, node): the HALF * HALF pairs of minhashes of each class, hashed with their place (i, j), which is also in the key's last six bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                m = np.ascontiguousarray(np.stack([part.column(1 + i).to_numpy() for i in range(HALF)], 1)).view(np.uint32).reshape(-1, 2, HALF).astype(np.uint64)
                place = np.arange(HALF, dtype=np.uint64)
                left, right = W.mix(m[:, 0] << U(8) | place), W.mix(m[:, 1] << U(8) | place + U(HALF))
                keys = W.mix(left[:, :, None] + right[:, None, :] * U(0xD6E8FEB86659FD93)).reshape(len(m), -1)
                keys = keys & ~U(HALF * HALF - 1) | np.arange(HALF * HALF, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), HALF * HALF))], ["key", "node"])

    return classes.select("node", *_BANDS).mapInArrow(run, "key long, node long")


def _equal(a: str, b: str) -> Column:
    """How many of the 32 sketch bytes two rows share: each byte of the exclusive or is folded into its lowest bit."""
    differ = None
    for i in range(4):
        x = F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))
        for by in (1, 2, 4):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        ones = F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
        differ = ones if differ is None else differ + ones
    return F.lit(SKETCH) - differ


def _close(a: str, b: str, percent: int) -> Column:
    """What two classes need before their sets are compared: sizes that allow the likeness, and alike sketches."""
    least, most = F.least(F.col(f"{a}n"), F.col(f"{b}n")), F.greatest(F.col(f"{a}n"), F.col(f"{b}n"))
    return (100 * least >= percent * most) & (_equal(a, b) >= LEAST_EQUAL)


def _first_key(key: Column, a: str, b: str) -> Column:
    """Whether a key that two classes share is the first such: its place is that of their first equal minhash in either collection."""

    def first(bands: list[str]) -> Column:
        found = None
        for i, band in enumerate(bands):
            differ = F.col(f"{a}{band}").bitwiseXOR(F.col(f"{b}{band}"))
            for k, half in enumerate((0xFFFFFFFF, -0x100000000)):
                equal, place = differ.bitwiseAND(F.lit(half)) == 0, F.lit(2 * i + k)
                found = F.when(equal, place) if found is None else found.when(equal, place)
        return found

    return key.bitwiseAND(F.lit(HALF * HALF - 1)) == first(_BANDS[: HALF // 2]) * HALF + first(_BANDS[HALF // 2 :])


def _prefixed(classes: DataFrame, p: str, *more: str) -> DataFrame:
    return classes.select(F.col("node").alias(p), *[F.col(c).alias(p + c) for c in ("n", "s0", "s1", "s2", "s3", *more)])


#: Bits of the largest filter that is broadcast: 32 MB. Beyond some ten millions of wanted ids it lets more and more through, which the join drops.
FILTER_BITS = 1 << 28


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    """Three places of each id in a filter of ``size`` bits (a power of two)."""
    h = W.mix(ids.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, 4, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return (h & U(size - 1)).astype(np.int64)


def _filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``doc_id``: words are joined by grouped OR, so at most FILTER_BITS / 64 rows reach the driver."""
    size = 1 << 10
    count = ids.count()
    while size < min(16 * count, FILTER_BITS):
        size *= 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(batch.column(0).to_numpy(), size).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((U(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    got = ids.select("doc_id").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def _full(ids: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(node, set) of the documents in the column doc_id of ``ids``, and of a few others.

    Texts aren't shuffled: a bounded Bloom filter of the ids picks the texts whose sets are made; joins on node drop the rest."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(ids))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = shared.value
        for batch in batches:
            at = _bits(batch.column(0).fill_null(0).to_numpy(), len(some) << 6)
            maybe = ((some[at >> 6] >> (at & 63).astype(np.uint64)) & U(1)).all(1) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(maybe))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets(batch.column(1), n)], pa.binary())], ["node", "set"])

    return bounded(docs).mapInArrow(make, "node long, set binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b; ids of documents) whose full sets are alike enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    full = _full(wanted, docs, n)
    with_a = pairs.join(full.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = with_a.join(full.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return bounded(both.select("a", "b", "set_a", "set_b")).mapInArrow(compare, "a long, b long")


#: Under so many keys a centre meets its partners, so that a family's hub isn't one task.
SALTS = 32


def hubs(sifted: DataFrame) -> DataFrame:
    """(node, hub) of every class in a sifted pair: the centre with most sifted partners among its own centres (and itself, if it is one; ties: the least id).

    sifted: node, c (its centre)."""
    degree = sifted.groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    salted = degree.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rank = F.struct("d", (-F.col("c")).alias("id")).alias("best")
    partner = sifted.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["c", "salt"]).select("node", rank)
    own = degree.select(F.col("c").alias("node"), rank)
    return partner.unionByName(own).groupBy("node").agg((-F.max("best")["id"]).alias("hub"))


#: Shingles that one side of a block holds at most on average (or one set, if larger), and the least that a member counts as: they bound
#: what meets in a task to some thousands of members.
BLOCK_SHINGLES, LEAST_SHINGLES = 250_000, 250


def family_links(members: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between different components within a hub's family; members: node, n, hub, component.

    Only members outside their hub's component are one side; all members are the other. Both sides are dealt into blocks, and every
    pair of blocks is one group. A hub may itself have another hub: it is among the members all the same, under that one, and its
    pairs with its own family are confirmed already."""
    of_hub = members.select("hub").distinct().join(members.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")), "hub")
    rows = members.join(of_hub, "hub").withColumn("stray", F.col("component") != F.col("hub_component"))
    weight = F.greatest(F.col("n"), F.lit(LEAST_SHINGLES))
    size = rows.groupBy("hub").agg(F.sum(weight).alias("every"), F.sum(F.when(F.col("stray"), weight).otherwise(F.lit(0))).alias("strays")).where("strays > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_SHINGLES).cast("int")
    size = checkpointed(size.select("hub", blocks("strays").alias("of_left"), blocks("every").alias("of_right")))
    rows = rows.join(size, "hub").withColumn("_h", F.xxhash64("node"))
    place = lambda of: F.pmod(F.col("_h"), F.col(of)).cast("int")
    span = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = rows.where("stray").select("hub", "node", "component", F.lit(0).alias("side"), place("of_left").alias("i"), span("of_right").alias("j"))
    right = rows.select("hub", "node", "component", F.lit(1).alias("side"), span("of_left").alias("i"), place("of_right").alias("j"))
    dealt = left.unionByName(right)
    full = _full(rows.select(F.col("node").alias("doc_id")), docs, n)

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        node, component = table["node"].to_numpy(), table["component"].to_numpy()
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["set"]]
        length = np.array([len(x) for x in found])
        _, token, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        many = count > 1  # others are in no intersection
        column = np.cumsum(many) - 1
        owner = np.repeat(np.arange(len(found)), length)
        keep = many[token]
        owner, token = owner[keep], column[token[keep]]
        row = np.zeros(len(found), np.int64)
        for s in (0, 1):
            row[side == s] = np.arange((side == s).sum())
        x, y = (np.flatnonzero(side == s) for s in (0, 1))
        both = np.zeros((len(x), len(y)), np.float32)
        for lo in range(0, int(many.sum()), 4096):  # columns by the thousand, so that the dense matrices stay small
            parts = []
            for s, of in ((0, x), (1, y)):
                mine = (token >= lo) & (token < lo + 4096) & (side[owner] == s)
                dense = np.zeros((len(of), 4096), np.float32)
                dense[row[owner[mine]], token[mine] - lo] = 1
                parts.append(dense)
            both += parts[0] @ parts[1].T
        both = both.astype(np.int64)
        alike = 100 * both >= percent * (length[x][:, None] + length[y][None, :] - both)
        i, j = np.nonzero(alike & (component[x][:, None] != component[y][None, :]))
        return pa.table({"a": node[x][i], "b": node[y][j]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return dealt.join(full, "node").groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long")


#: Members of a bucket that one task of a block pair holds on either side, about.
BLOCK_MEMBERS = 4_096


def across_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """(a, b) of one bucket, different components and different hubs that pass the sieve; rest: key, node, component, hub, n, sketch, bands.

    Of a bucket, one side are the members outside its most frequent component (or hub, if that is more frequent), the other all: a large family with a few
    strangers costs its size times the strangers. Both sides of a bucket with more than BLOCK_MEMBERS are dealt into blocks, and each pair of blocks is a join key of its own."""

    def most(by: str) -> DataFrame:
        each = rest.groupBy("key", by).agg(F.count(F.lit(1)).alias("of"))
        return each.groupBy("key").agg(F.sum("of").alias("m"), F.max(F.struct("of", by)).alias(f"most_{by}"))

    top = most("component").join(most("hub").drop("m"), "key")
    common = F.greatest("most_component.of", "most_hub.of")
    blocks = lambda c: F.ceil(c / BLOCK_MEMBERS).cast("int")
    stranger = F.when(F.col("most_component.of") >= F.col("most_hub.of"), F.col("component") != F.col("most_component.component")).otherwise(F.col("hub") != F.col("most_hub.hub"))
    rows = rest.join(top, "key").withColumns({"stranger": stranger, "left": blocks(F.col("m") - common), "right": blocks(F.col("m")), "_h": F.xxhash64("node")}).where("left > 0").drop("most_component", "most_hub", "m")
    rows = checkpointed(rows)
    more = ["stranger", "component", "hub", "n", *_SKETCH, *_BANDS]
    place = lambda of: F.pmod("_h", F.col(of)).cast("int")

    def side(df: DataFrame, p: str, own: str, own_of: str, other: str, other_of: str) -> DataFrame:
        """Each row once for every block of the other side; where that has one block, nothing is multiplied."""
        named = df.select("key", place(own_of).alias(own), other_of, F.col("node").alias(p), *[F.col(c).alias(p + c) for c in more])
        one = named.where(F.col(other_of) == 1).withColumn(other, F.lit(0))
        several = named.where(F.col(other_of) > 1).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_of) - 1)))
        return one.unionByName(several).drop(other_of)

    once = ~F.col("bstranger") | (F.col("a") < F.col("b"))  # two strangers meet on both sides
    different = once & (F.col("acomponent") != F.col("bcomponent")) & (F.col("ahub") != F.col("bhub"))
    met = side(rows.where("stranger"), "a", "i", "left", "j", "right").join(side(rows, "b", "j", "right", "i", "left"), ["key", "i", "j"])
    return met.where(different & _first_key(F.col("key"), "a", "b") & _close("a", "b", percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def groups(docs: DataFrame, n: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", versions: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row. ``versions``: ids may have several texts (False: the caller knows that none has)."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    docs = apart(docs) if versions else docs.withColumns({"many": F.lit(False), "node": F.col("doc_id")})
    rows = checkpointed(profiles(docs.select("doc_id", "node", "many", "text"), n))
    docs = docs.select(F.col("node").alias("doc_id"), "text")
    sketch = [F.first(c).alias(c) for c in (*_SKETCH, *_BANDS)]
    classes = checkpointed(rows.where("n_shingles > 0 AND node IS NOT NULL").groupBy("h1", "h2").agg(F.min("node").alias("node"), F.first("n_shingles").alias("n"), *sketch))

    keys = table_keys(classes)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = checkpointed(keys.join(sizes, "key"))  # members of buckets of two and more
    weight = shared.groupBy("node").agg(F.sum("size").alias("w"))
    heaviest = F.max(F.struct("w", (-F.col("node")).alias("id")))
    centres = shared.join(weight, "node").groupBy("key").agg((-heaviest["id"]).alias("c"))
    starred = checkpointed(shared.join(centres, "key"))
    pairs = starred.where("node <> c").select("node", "c").distinct()
    met = pairs.withColumns({"a": F.least("node", "c"), "b": F.greatest("node", "c")}).join(_prefixed(classes, "a"), "a").join(_prefixed(classes, "b"), "b")
    sifted = checkpointed(met.where(_close("a", "b", percent)).select("a", "b", "node", "c"))
    links = confirmed(sifted.select("a", "b").distinct(), docs, n, percent)
    if versions and not (several := rows.where("many AND n_shingles > 0")).isEmpty():
        own = checkpointed(several.select("doc_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "node"))
        links = links.unionByName(own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b")))
    links = checkpointed(links)
    found = components(links)

    hub = checkpointed(hubs(sifted))
    placed = lambda df: df.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    within = checkpointed(family_links(placed(hub).join(classes.select("node", "n"), "node"), docs, n, percent))
    if not within.isEmpty():
        links = checkpointed(links.unionByName(within))
        found = components(links)

    # Buckets of three or more whose members, the centre aside, still lie in several components under several hubs. A pair that meets in
    # several buckets is taken in the first: if one of them is the centre there, the pair is known already.
    place = placed(classes.select("node").join(hub, "node", "left").select("node", F.coalesce("hub", "node").alias("hub")))
    rest = starred.where("size > 2 AND node <> c").select("key", "node").join(place, "node")
    mixed = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("hub").alias("u"), F.max("hub").alias("v")).where("x < y AND u < v").select("key")
    rest = checkpointed(rest.join(mixed, "key").join(classes.select("node", "n", *_SKETCH, *_BANDS), "node"))
    across = checkpointed(across_pairs(rest, percent))
    if not across.isEmpty() and not (more := checkpointed(confirmed(across, docs, n, percent))).isEmpty():
        found = components(links.unionByName(more))

    member = classes.join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    linked, alone = rows.where("n_shingles > 0 AND node IS NOT NULL"), rows.where("n_shingles = 0 OR node IS NULL")  # rows without a set share no join key
    out = linked.join(member, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def brute(docs: list[tuple[int, str | None]], n: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id) from the definition, over all pairs that share a shingle."""
    import re
    from collections import defaultdict

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made, holders = {}, defaultdict(list)
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        made[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        for s in made[d]:
            holders[s].append(d)
    parent = {d: d for d in made}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    both: dict = defaultdict(int)
    for own in holders.values():
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                both[x, y] += 1
    for (x, y), k in both.items():
        if 100 * k >= percent * (len(made[x]) + len(made[y]) - k):
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    return {d: (len(made[d]), root(d)) for d in made}
