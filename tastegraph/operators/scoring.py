"""Scores and explanations of many users in one plan.

rated: user, item, z[, weight] (further key columns, such as a split, are named in ``keys``).
edges: i, j, sim. stats: item, n_ratings, mean_rating, z_mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScoringConfig


def input_values(rated: DataFrame, stats: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """rated with ``value``: z, less the item's consensus if residuals are the input."""
    if not config.use_residual_input:
        return rated.withColumn("value", F.col("z"))
    with_mean = rated.join(stats.select("item", F.col("z_mean").alias("_zm")), "item", "left")
    return with_mean.withColumn("value", F.col("z") - F.coalesce("_zm", F.lit(0.0))).drop("_zm")


def evidence(rated: DataFrame, edges: DataFrame, keys: Sequence[str] = ("user",), known: DataFrame | None = None) -> DataFrame:
    """keys, item, num, den, n_neighbours: what a user's ratings say about every item that they reach. Needs ``value``.

    Every rating meets the edges of its item. Ratings are dealt by keys before that, so that with edges small enough to be broadcast (written ones: Spark knows
    their size) each user's sums are made where the ratings are, and the many rows between are never shuffled.

    ``known`` (item): of these, items that the user rated are left out, by an edge of each item to itself that marks them."""
    w = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in rated.columns else F.lit(1.0)
    left = rated.select(*keys, F.col("item").alias("i"), "value", w.alias("w")).repartition(*keys)
    into = edges.select("i", F.col("j").alias("item"), "sim", F.lit(1).alias("_said"))
    if known is not None:
        into = into.unionByName(known.select(F.col("item").alias("i"), "item", F.lit(None).cast("double").alias("sim"), F.lit(None).cast("int").alias("_said")))
    met = left.join(into, "i")
    sums = [F.sum(F.col("sim") * F.col("value") * F.col("w")).alias("num"), F.sum(F.abs("sim") * F.col("w")).alias("den"), F.count("_said").cast("int").alias("n_neighbours")]
    if known is None:
        return met.groupBy(*keys, "item").agg(*sums)
    return met.groupBy(*keys, "item").agg(*sums, F.count(F.lit(1)).alias("_n")).where(F.col("_n") == F.col("n_neighbours")).drop("_n")


def median_popularity(stats: DataFrame) -> DataFrame:
    """One row: the exact median of the positive n_ratings."""
    return stats.where("n_ratings > 0").agg(F.median("n_ratings").alias("median_n"))


def candidates(rated: DataFrame | None, found: DataFrame, stats: DataFrame, exclude: DataFrame | None, keys: Sequence[str] = ("user",), every: bool = True) -> DataFrame:
    """keys, item, num, den, n_neighbours of all items that may be offered: not rated, not excluded.

    ``every``: items without any evidence too (den 0), as users x catalogue rows, which is what full rankings need. Otherwise only
    reached items, which are all that can pass a support floor above 0; use that at scale. ``rated`` None: found has no rated items, as ``evidence`` makes it."""
    keys = list(keys)
    if every:
        users = rated.select(*keys).distinct()
        pool = users.join(stats.select("item"))  # each user's candidate list is the catalogue
        found = pool.join(found, [*keys, "item"], "left")
    if rated is not None:
        found = found.join(rated.select(*keys, "item"), [*keys, "item"], "left_anti")
    if exclude is not None:
        found = found.join(exclude, [k for k in keys if k in exclude.columns] + ["item"], "left_anti")
    return found.withColumns({"num": F.coalesce("num", F.lit(0.0)), "den": F.coalesce("den", F.lit(0.0)), "n_neighbours": F.coalesce("n_neighbours", F.lit(0))})


def terms(config: ScoringConfig, num: Column, den: Column, z_mean: Column, n_ratings: Column, median_n: Column) -> dict[str, Column]:
    """pred_d, pred_z, rank_score (null where unrankable) and scoreable from a candidate's sums."""
    pred = F.when(den > F.lit(config.epsilon), num / den).otherwise(F.lit(0.0))
    if config.pred_shrinkage_k > 0:
        pred = pred * den / (den + F.lit(float(config.pred_shrinkage_k)))
    trust = den / (den + F.lit(float(config.rank_shrinkage_k))) if config.rank_shrinkage_k > 0 else F.lit(1.0)
    consensus = F.coalesce(z_mean, F.lit(0.0))
    if config.use_residual_input:
        pred_d, pred_z, base = pred, consensus + pred, F.lit(float(config.consensus_beta)) * consensus + pred * trust
    else:
        pred_d, pred_z, base = F.lit(None).cast("double"), pred, pred * trust
    penalty = F.lit(float(config.popularity_alpha)) * F.log10(F.greatest(n_ratings.cast("double"), F.lit(1.0)) / median_n)
    scoreable = den >= F.lit(float(config.min_support))
    return {"pred_d": pred_d, "pred_z": pred_z, "rank_score": F.when(scoreable, base - penalty), "scoreable": scoreable}


def scored(pool: DataFrame, stats: DataFrame, config: ScoringConfig = ScoringConfig(), keys: Sequence[str] = ("user",)) -> DataFrame:
    """keys, item, pred_z, pred_d, support, n_neighbours, rank_score (null: not rankable), scoreable, n_ratings, mean_rating, z_mean."""
    rows = pool.join(stats.select("item", "n_ratings", "mean_rating", "z_mean"), "item").join(F.broadcast(median_popularity(stats)))
    rows = rows.withColumns(terms(config, F.col("num"), F.col("den"), F.col("z_mean"), F.col("n_ratings"), F.col("median_n")))
    return rows.select(*keys, "item", "pred_z", "pred_d", F.col("den").alias("support"), "n_neighbours", "rank_score", "scoreable", "n_ratings", "mean_rating", "z_mean")


def score(rated: DataFrame, edges: DataFrame, stats: DataFrame, config: ScoringConfig = ScoringConfig(), exclude: DataFrame | None = None, keys: Sequence[str] = ("user",), every: bool = True) -> DataFrame:
    values = input_values(rated, stats, config)
    if every:
        pool = candidates(rated, evidence(values, edges, keys), stats, exclude, keys)
    else:  # items outside stats, rated or not, leave in ``scored``
        pool = candidates(None, evidence(values, edges, keys, stats.select("item").distinct()), stats, exclude, keys, False)
    return scored(pool, stats, config, keys)


def rank(df: DataFrame, keys: Sequence[str], by: str, output: str, fill: float | None = None) -> DataFrame:
    """1-based rank in each key by ``by`` descending, ties by item; nulls count as ``fill`` or come last."""
    value = F.round(F.coalesce(F.col(by).cast("double"), F.lit(fill)) if fill is not None else F.col(by).cast("double"), 9)
    return df.withColumn(output, F.row_number().over(Window.partitionBy(*keys).orderBy(value.desc_nulls_last(), "item")))


def explain(rated: DataFrame, edges: DataFrame, stats: DataFrame, wanted: DataFrame, top: int = 5, config: ScoringConfig = ScoringConfig(), keys: Sequence[str] = ("user",), weighted: bool = False) -> DataFrame:
    """keys, candidate, item, contribution, place: the ratings that speak loudest for or against each wanted (keys, item).

    A contribution is similarity times input value; recency weights only if ``weighted``."""
    keys = list(keys)
    values = input_values(rated, stats, config)
    value = F.col("value") * (F.coalesce(F.col("weight"), F.lit(1.0)) if weighted and "weight" in rated.columns else F.lit(1.0))
    # a user's ratings meet that user's few wanted items first, and then the edges: not every edge of every rating
    asked = wanted.select(*keys, F.col("item").alias("candidate")).distinct()
    into = edges.select(F.col("i").alias("item"), F.col("j").alias("candidate"), "sim")
    said = values.select(*keys, "item", value.alias("value")).join(asked, keys).join(into, ["item", "candidate"])
    said = said.withColumn("contribution", F.col("sim") * F.col("value"))
    order = Window.partitionBy(*keys, "candidate").orderBy(F.desc(F.round(F.abs("contribution"), 9)), "item")
    return said.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select(*keys, "candidate", "item", "contribution", "place")


def stars(z: Column, mean: Column, sigma: Column, gain: float = 1.0) -> Column:
    """A z-score on the user's own scale, from half a star to five; a gain above 1 undoes the damping of predictions."""
    return F.greatest(F.lit(0.5), F.least(F.lit(5.0), mean + sigma * F.lit(float(gain)) * z))
