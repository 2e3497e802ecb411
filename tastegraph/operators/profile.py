"""A member's taste profile from an export's tables, for any number of members at once (``keys``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ProfileConfig

YEAR_SECONDS = 365.25 * 86_400


def keep_last(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The last row of each combination (nulls compare equal)."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def keep_first(rows: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def member_of(rows: DataFrame, keys: DataFrame | None, on: Sequence[str], output: str) -> DataFrame:
    """rows with a boolean: whether ``keys`` has the same ``on`` (null years are equal to null years)."""
    if keys is None:
        return rows.withColumn(output, F.lit(False))
    known = keys.select(*[F.col(c).alias(f"_{c}") for c in on], F.lit(True).alias("_hit")).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    return rows.join(known, same, "left").withColumn(output, F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_{c}" for c in on])


def recency_weight(age_seconds: Column, half_life_years: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_seconds, F.lit(0)) / F.lit(YEAR_SECONDS) / F.lit(float(half_life_years)))


def bulk_import(ratings: DataFrame, keys: Sequence[str] = ("user",), share: float = 0.25) -> DataFrame:
    """keys, busiest (the earliest of equally busy dates), top_share, bulk: whether one date holds more than ``share`` of the dated ratings."""
    dates = ratings.where(F.col("logged_date").isNotNull()).groupBy(*keys, F.col("logged_date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    top = F.max_by("date", F.struct(F.col("n"), (-F.unix_seconds(F.col("date").cast("timestamp"))).alias("t")))
    return dates.groupBy(*keys).agg(top.alias("busiest"), (F.max("n") / F.sum("n")).alias("top_share")).withColumn("bulk", F.col("top_share") > F.lit(share))


def profile(ratings: DataFrame, likes: DataFrame | None = None, reviews: DataFrame | None = None, config: ProfileConfig = ProfileConfig(), keys: Sequence[str] = ("user",)) -> tuple[DataFrame, DataFrame]:
    """(films, stats). ratings: keys, title, year, rating, logged_date, ord (row order). likes: keys, title, year. reviews also has review.

    films: the last rating of each (title, year) with z, weight, is_liked, has_review.
    stats: keys, n, mean, sigma_raw, sigma, reference_date, busiest, top_share, warnings (array)."""
    keys = list(keys)
    films = keep_last(ratings.where(F.col("rating").isNotNull()), [*keys, "title", "year"], "ord")
    # Sums of half stars and of their squares are exact in any order, so a spread of just the floor isn't below it.
    n, squares = F.count(F.lit(1)), F.sum(F.col("rating") * F.col("rating"))
    spread = F.sqrt(F.greatest(n * squares - F.sum("rating") * F.sum("rating"), F.lit(0.0))) / n
    stats = films.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"), spread.alias("sigma_raw"), F.greatest(spread, F.lit(config.sigma_floor)).alias("sigma"), F.max("logged_date").alias("reference_date"))
    stats = stats.join(bulk_import(films, keys, config.bulk_share), keys, "left")
    decays = config.recency_half_life_years is not None
    stats = stats.withColumn(
        "warnings",
        F.filter(
            F.array(
                F.when(F.col("sigma_raw") < config.sigma_floor, F.lit("narrow rating spread: sigma was floored")),
                F.when(F.col("reference_date").isNull(), F.lit("no usable dates: recency weighting is off")),
                F.when(F.col("bulk") & F.lit(decays), F.lit("one date holds a large share of the ratings: recency weighting is unreliable")),
            ),
            lambda w: w.isNotNull(),
        ),
    )
    rows = films.join(stats.select(*keys, "mean", "sigma", "reference_date"), keys)
    rows = rows.withColumn("z", (F.col("rating") - F.col("mean")) / F.col("sigma"))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    if decays:
        age = seconds("reference_date") - seconds("logged_date")
        middle = rows.withColumn("_age", age).groupBy(*keys).agg(F.median("_age").alias("_middle"))  # undated ratings get the median age
        rows = rows.withColumn("_age", age).join(middle, keys, "left")
        rows = rows.withColumn("weight", F.coalesce(recency_weight(F.coalesce("_age", "_middle"), config.recency_half_life_years), F.lit(1.0))).drop("_age", "_middle")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = member_of(rows, likes, [*keys, "title", "year"], "is_liked")
    rows = member_of(rows, None if reviews is None else reviews.where(F.trim("review") != ""), [*keys, "title", "year"], "has_review")
    if config.use_likes:
        rows = rows.withColumn("z", F.col("z") + F.when(F.col("is_liked"), F.lit(config.like_bonus_z)).otherwise(F.lit(0.0)))
    return rows.drop("mean", "sigma", "reference_date"), stats


def seen_titles(tables: Sequence[DataFrame], keys: Sequence[str] = ("user",)) -> DataFrame:
    """Everything seen: the tables (keys, title, year, ...) one after another, the first row of each (title, year) kept."""
    rows = None
    for place, t in enumerate(tables):
        t = t.select(*keys, "title", "year", F.lit(place).alias("_table"), (F.col("ord") if "ord" in t.columns else F.lit(0)).alias("_ord"))
        rows = t if rows is None else rows.unionByName(t)
    return keep_first(rows, [*keys, "title", "year"], "_table", "_ord").select(*keys, "title", "year")


def extremes(films: DataFrame, n: int = 3, keys: Sequence[str] = ("user",)) -> DataFrame:
    """keys, side (``loved`` or ``hated``), place, title, year, rating, z: the n highest and the n lowest z of each key (ties: the earlier row)."""
    out = None
    for side, order in (("loved", F.desc(F.round("z", 9))), ("hated", F.asc(F.round("z", 9)))):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "ord"))
        one = films.withColumn("place", place).where(F.col("place") <= n).select(*keys, F.lit(side).alias("side"), "place", "title", "year", "rating", "z")
        out = one if out is None else out.unionByName(one)
    return out


def rated_exactly(films: DataFrame, rating: float = 5.0, n: int = 6, keys: Sequence[str] = ("user",)) -> DataFrame:
    """The first n films of each key, in row order, that have exactly this rating."""
    return films.where(F.col("rating") == rating).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where(F.col("place") <= n)


def summary(films: DataFrame, stats: DataFrame, keys: Sequence[str] = ("user",)) -> DataFrame:
    """keys, n, mean, sigma_raw, sigma, reference_date, warnings, reviewed, liked, and the least, median and most recency weight."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    by = films.groupBy(*keys).agg(count("has_review").alias("reviewed"), count("is_liked").alias("liked"), F.min("weight").alias("weight_min"), F.median("weight").alias("weight_median"), F.max("weight").alias("weight_max"))
    return stats.select(*keys, "n", "mean", "sigma_raw", "sigma", "reference_date", "warnings").join(by, list(keys), "left")
