"""Ratings fact: filtering, dense ids, statistics and z-scores. Columns: user, item, rating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SimilarityConfig, StagingConfig


def unique_pairs(ratings: DataFrame) -> DataFrame:
    """One row for each (user, item): repeated ratings are averaged, so that pair products count once."""
    return ratings.groupBy("user", "item").agg(F.avg("rating").alias("rating"))


def two_pass_filter(ratings: DataFrame, config: StagingConfig = StagingConfig()) -> DataFrame:
    """Each pass keeps items with enough ratings, then users with enough of what is left; a fixed number of passes."""
    for _ in range(config.passes):
        for key, least in (("item", config.min_item_ratings), ("user", config.min_user_ratings)):
            enough = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key)
            ratings = ratings.join(enough, key, "left_semi")
    return ratings


def dense_index(ids: DataFrame, column: str, output: str) -> DataFrame:
    """(column, output): distinct ids in order, numbered from 0 without a one-partition sort.

    The least id of each partition of a range sort is collected (one value for each shuffle partition), and these values deal the ids into ranges: what
    range an id is in follows from the id alone, however often and in however many partitions the plan runs. Each range is numbered by itself, and the
    counts of the ranges before are added."""
    known = ids.select(column).where(F.col(column).isNotNull()).distinct()
    least = known.repartitionByRange(column).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(column).alias("_least")).collect()
    marks = F.array(*[F.lit(x) for x in sorted(r["_least"] for r in least)]) if least else F.array().cast(f"array<{known.dtypes[0][1]}>")
    placed = known.withColumn("_p", F.size(F.filter(marks, lambda m: m <= F.col(column))))
    counts = {r["_p"]: r["_n"] for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).collect()}
    before = F.array(*[F.lit(sum(n for p, n in counts.items() if p < k)) for k in range(len(least) + 1)])
    return placed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(column))).select(column, (F.col("_r") - 1 + F.get(before, F.col("_p"))).cast("int").alias(output))


def index_ratings(ratings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ratings with user_idx and item_idx, user map, item map); indices follow the order of ids."""
    users, items = dense_index(ratings, "user", "user_idx"), dense_index(ratings, "item", "item_idx")
    return ratings.join(users, "user").join(items, "item").select("user_idx", "item_idx", "rating"), users, items


def item_stats(ratings: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """item, n_ratings, mean_rating; with a catalogue all its items, without ratings at 0 and null."""
    stats = ratings.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("n_ratings"), F.avg("rating").alias("mean_rating"))
    if catalogue is None:
        return stats
    return catalogue.join(stats, "item", "left").withColumn("n_ratings", F.coalesce("n_ratings", F.lit(0)))


def user_stats(ratings: DataFrame, sigma_floor: float = 0.5) -> DataFrame:
    """user, n, mean, sigma_raw (population), sigma (floored)."""
    s = F.stddev_pop("rating")
    return ratings.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"), s.alias("sigma_raw"), F.greatest(s, F.lit(float(sigma_floor))).alias("sigma"))


def z_scores(ratings: DataFrame, sigma_floor: float = 0.5) -> DataFrame:
    """ratings with z. One shuffle by user serves both the statistics and the rows (a window), so wide rows aren't joined."""
    w = Window.partitionBy("user")
    sigma = F.greatest(F.stddev_pop("rating").over(w), F.lit(float(sigma_floor)))
    return ratings.withColumn("z", (F.col("rating") - F.avg("rating").over(w)) / sigma)


def consensus(z: DataFrame, config: SimilarityConfig = SimilarityConfig(), exclude_users: DataFrame | None = None) -> DataFrame:
    """item, n, z_mean: the mean z of an item's raters, shrunk towards 0 by n / (n + lambda).

    ``exclude_users``: raters whose ratings don't count (off by default, as when statistics come from everybody)."""
    z = z if exclude_users is None else without_users(z, exclude_users)
    n = F.count(F.lit(1))
    return z.groupBy("item").agg(n.alias("n"), (F.avg("z") * n / (n + F.lit(float(config.consensus_shrinkage_lambda)))).alias("z_mean"))


def without_users(rows: DataFrame, users: DataFrame) -> DataFrame:
    return rows.join(users.select("user").distinct(), "user", "left_anti")


def assert_disjoint(built_on: DataFrame, users: DataFrame) -> None:
    """ValueError if any of ``users`` is among the raters that the similarity was built on (their ratings, or any table with ``user``)."""
    if not built_on.join(users.select("user"), "user", "left_semi").isEmpty():
        raise ValueError("some evaluation users were not excluded from the similarity build")


def top_consensus(stats: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """The n items with the highest z_mean (ties: the least item), with their place and metadata; stats: item, n_ratings, z_mean."""
    top = stats.orderBy(F.desc(F.round("z_mean", 9)), "item").limit(n)
    place = F.row_number().over(Window.orderBy(F.desc(F.round("z_mean", 9)), "item"))  # of n rows
    return top.withColumn("place", place).join(items, "item", "left")


def fact_summary(ratings: DataFrame) -> DataFrame:
    """One row: ratings, users, items (distinct)."""
    return ratings.agg(F.count(F.lit(1)).alias("ratings"), F.countDistinct("user").alias("users"), F.countDistinct("item").alias("items"))


def popularity_cuts(stats: DataFrame, at: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """One row with ``cuts``: exact quantiles of n_ratings over the catalogue, interpolated."""
    return stats.agg(F.percentile("n_ratings", F.array(*[F.lit(float(x)) for x in at])).alias("cuts"))


def popularity_band(n: str = "n_ratings", cuts: str = "cuts"):
    """Q1 to Q5: one more than the cuts that are no greater."""
    return F.concat(F.lit("Q"), (F.size(F.filter(cuts, lambda c: c <= F.col(n))) + 1).cast("string"))
