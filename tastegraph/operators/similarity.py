"""Item-item similarity: an all-pairs self-join on user, shrunk by support and cut to the strongest neighbours.

Pairs grow with the square of a user's ratings. Only ``a.item < b.item`` is joined (half of the pairs) and mirrored after
aggregation; the aggregation combines before its shuffle. The items of a user with more than BLOCK ratings are dealt into blocks, and each pair of blocks is
a join key of its own, so that no user's pairs are one task; lighter users have one block and nothing is repeated for them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SimilarityConfig
from ..sources import staging
from .ratings import without_users, z_scores


def vectors(ratings: DataFrame, config: SimilarityConfig = SimilarityConfig(), exclude_users: DataFrame | None = None) -> DataFrame:
    """user, item, v: z-scores (item-centred if asked for) divided by the item's norm over all its raters.

    Norms are those of whole items, not of common raters, also when centred: a cosine. z comes from all of a user's ratings; excluded users leave afterwards."""
    z = z_scores(ratings, config.sigma_floor).select("user", "item", "z")
    z = z if exclude_users is None else without_users(z, exclude_users)
    item = Window.partitionBy("item")
    if config.item_centered:
        z = z.withColumn("z", F.col("z") - F.avg("z").over(item))
    norm = F.sqrt(F.sum(F.col("z") * F.col("z")).over(item))
    return z.select("user", "item", (F.col("z") / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).alias("v"))


#: Ratings of a user in one block.
BLOCK = 1_024


def pairs(v: DataFrame, config: SimilarityConfig = SimilarityConfig()) -> DataFrame:
    """i, j (i < j), sim, n_co: cosine over common raters, times n_co / (n_co + lambda)."""
    heavy = v.groupBy("user").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_of")).where("_of > 1")
    v = v.join(heavy, "user", "left").withColumn("_of", F.coalesce("_of", F.lit(1)))
    own, every = F.pmod(F.xxhash64("item"), F.col("_of")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_of") - 1))
    a = v.select("user", own.alias("_p"), every.alias("_q"), F.col("item").alias("i"), F.col("v").alias("va"))
    b = v.select("user", every.alias("_p"), own.alias("_q"), F.col("item").alias("j"), F.col("v").alias("vb"))
    met = a.join(b, ["user", "_p", "_q"]).where(F.col("i") < F.col("j"))
    return _cosine(met, config)


def _cosine(met: DataFrame, config: SimilarityConfig) -> DataFrame:
    n = F.count(F.lit(1))
    return met.groupBy("i", "j").agg((F.sum(F.col("va") * F.col("vb")) * n / F.greatest(n + F.lit(float(config.shrinkage_lambda)), F.lit(1e-9))).alias("sim"), n.alias("n_co"))


def mirrored(half: DataFrame) -> DataFrame:
    """Both directions of each pair, in one pass over the pairs."""
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select(both.alias("e"), "sim", "n_co").select("e.i", "e.j", "sim", "n_co")


def strongest(edges: DataFrame, k: int) -> DataFrame:
    """The k edges of each i with the largest magnitude (ties by j); zero similarities are no edges. The result is directed."""
    order = Window.partitionBy("i").orderBy(F.desc(F.round(F.abs("sim"), 9)), "j")
    return edges.where("sim <> 0").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


#: Pairs, counted in both directions, of one pass of ``build``.
PASS = 48_000_000


def _passes(ratings: DataFrame) -> int:
    """How many passes keep each under PASS pairs: there are no more than users' ratings squared, nor than items squared."""
    met = ratings.groupBy("user").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    return 1 if met <= PASS else max(1, math.ceil(min(met, float(ratings.select("item").distinct().count()) ** 2) / PASS))


def _lists(v: DataFrame) -> DataFrame:
    """a, b: arrays of (item, v) that a user's ratings are dealt into, one pair of blocks a row; b is null where it equals a (users of one block)."""
    dealt = v.join(v.groupBy("user").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_of")), "user")
    lists = dealt.groupBy("user", "_of", F.pmod(F.xxhash64("item"), F.col("_of")).alias("_p")).agg(F.collect_list(F.struct("item", "v")).alias("a"))
    heavy = lists.where("_of > 1")
    both = heavy.select("user", "a").join(heavy.select("user", F.col("a").alias("b")), "user").select("a", "b")
    return lists.where("_of = 1").select("a", F.lit(None).cast(lists.schema["a"].dataType).alias("b")).unionByName(both)


def _one_pass(lists: DataFrame, config: SimilarityConfig, at: int, of: int) -> DataFrame:
    """The strongest edges of the items that this pass takes, from all of their pairs."""
    mine = F.filter("a", lambda x: F.pmod(F.xxhash64(x["item"]), F.lit(of)) == at)
    left = lists.select(F.explode(mine).alias("x"), F.coalesce("b", "a").alias("b"))
    met = left.select(F.col("x.item").alias("i"), F.col("x.v").alias("va"), F.explode("b").alias("y")).select("i", "va", F.col("y.item").alias("j"), F.col("y.v").alias("vb")).where("i <> j")
    return strongest(_cosine(met, config), config.top_k_neighbours)


def build(ratings: DataFrame, config: SimilarityConfig = SimilarityConfig(), exclude_users: DataFrame | None = None) -> DataFrame:
    """i, j, sim, n_co of unique (user, item) ratings.

    A catalogue of many items has nearly as many different pairs as users have pairs of ratings, too many to lie on disk at once. Beyond PASS of them, users' lists are
    written once, and items are taken in passes: each makes all pairs of its items, cuts them to the strongest and writes those before the next begins."""
    of = _passes(ratings)
    if of == 1:
        return strongest(mirrored(pairs(vectors(ratings, config, exclude_users), config)), config.top_k_neighbours)
    lists = staging.written(_lists(vectors(ratings, config, exclude_users)))
    parts = [staging.written(_one_pass(lists, config, at, of)) for at in range(of)]
    return reduce(DataFrame.unionByName, parts)


def neighbours(edges: DataFrame, items: DataFrame, item: int, n: int = 8) -> DataFrame:
    """The n nearest by signed similarity of one item, with the neighbours' metadata (items: item, ...)."""
    near = edges.where(F.col("i") == item).orderBy(F.desc(F.round("sim", 9)), "j").limit(n)
    return near.join(items.withColumnRenamed("item", "j"), "j", "left")
