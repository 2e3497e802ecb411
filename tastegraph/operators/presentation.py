"""What a ranked list may show: title types, works already started, one row for each work, few for each series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PresentationConfig
from ..functions import titles


def typed(items: DataFrame, types: DataFrame) -> DataFrame:
    """items (item, catalogue_id, ...) with title_type by raw id, else by the normalised id; unknown ids have null."""
    t = types.groupBy(F.col("catalogue_id").alias("_id")).agg(F.min("title_type").alias("_t"))
    out = items.withColumn("_norm", titles.catalogue_id(F.col("catalogue_id")))
    raw, norm = t.withColumnRenamed("_t", "_raw"), t.withColumnsRenamed({"_t": "_padded", "_id": "_nid"})
    out = out.join(raw, out["catalogue_id"] == raw["_id"], "left").join(norm, F.col("_norm") == norm["_nid"], "left")
    return out.withColumn("title_type", F.coalesce("_raw", "_padded")).drop("_norm", "_raw", "_padded", "_id", "_nid")


def allowed_types(items: DataFrame, config: PresentationConfig = PresentationConfig()) -> DataFrame:
    """items whose title_type isn't denied; unknown types stay, and everything does if the filter is off."""
    if not config.drop_non_films:
        return items
    return items.where(F.col("title_type").isNull() | ~F.col("title_type").isin(*config.excluded_types()))


def only_shorts(items: DataFrame, config: PresentationConfig = PresentationConfig()) -> DataFrame:
    return items.where(F.col("title_type") == config.short_type)


def popularity_window(df: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    df = df if least is None else df.where(F.col("n_ratings") >= least)
    return df if most is None else df.where(F.col("n_ratings") <= most)


def keyed(items: DataFrame) -> DataFrame:
    """items (item, clean_title, year, ...) with ``_work``, ``_series``, ``_bases`` and ``_shown``: what a list needs of titles, worked out once for each item and
    not for each row of every user's list. The functions below take these columns where they are and work them out where they aren't."""
    c = F.col("clean_title")
    return items.withColumns({"_work": titles.work_key(c, F.col("year")), "_series": titles.series_key(c), "_bases": titles.base_titles(c), "_shown": titles.display_title(c)})


def _of(df: DataFrame, name: str, make: Callable[[], Column]) -> Column:
    return F.col(name) if name in df.columns else make()


def seen_works(seen: DataFrame, keys: Sequence[str] = ("user",)) -> DataFrame:
    """keys, base of everything seen (keys, clean_title)."""
    return seen.select(*keys, F.explode(_of(seen, "_bases", lambda: titles.base_titles(F.col("clean_title")))).alias("base")).distinct()


def diversify(df: DataFrame, n: int, config: PresentationConfig = PresentationConfig(), seen: DataFrame | None = None, keys: Sequence[str] = ("user",), order: str = "rank") -> DataFrame:
    """The first n rows of each key that presentation allows; df: keys, item, clean_title, year, ``order`` [, pred_z, n_neighbours].

    Window form of a greedy pass: rows below the floors go; parts of works in ``seen`` (keys, base) go; of a work the first stays;
    of a series the first ``max_per_series`` stay; then the first n. With both kinds of deduplication off, it is the first n of df as it is."""
    keys = list(keys)
    first = lambda *by: F.row_number().over(Window.partitionBy(*keys, *by).orderBy(order, "item"))
    if not config.dedupe_same_work and not config.max_per_series:
        return df.withColumn("_n", first()).where(F.col("_n") <= n).drop("_n")
    if config.min_predicted_z is not None and "pred_z" in df.columns:
        df = df.where(F.coalesce(F.col("pred_z") >= config.min_predicted_z, F.lit(True)))
    if config.min_neighbours_to_show and "n_neighbours" in df.columns:
        df = df.where(F.coalesce(F.col("n_neighbours") >= config.min_neighbours_to_show, F.lit(True)))
    if config.dedupe_same_work:
        df = df.withColumn("_work", _of(df, "_work", lambda: titles.work_key(F.col("clean_title"), F.col("year"))))
        if seen is not None:
            bases = _of(df, "_bases", lambda: titles.base_titles(F.col("clean_title")))
            parts = df.where(F.startswith("_work", F.lit("work::"))).select(*keys, "item", F.explode(bases).alias("base"))
            df = df.join(parts.join(seen, [*[k for k in keys if k in seen.columns], "base"]).select(*keys, "item").distinct(), [*keys, "item"], "left_anti")
        df = df.withColumn("_w", first("_work")).where("_w = 1").drop("_w", "_work")
    if config.max_per_series:
        series = _of(df, "_series", lambda: titles.series_key(F.col("clean_title")))
        df = df.withColumn("_series", series).withColumn("_s", F.when(F.col("_series").isNotNull(), first("_series")))
        df = df.where(F.col("_s").isNull() | (F.col("_s") <= config.max_per_series)).drop("_s", "_series")
    return df.withColumn("_n", first()).where(F.col("_n") <= n).drop("_n")


def because(explained: DataFrame, items: DataFrame, n: int = 3, keys: Sequence[str] = ("user",)) -> DataFrame:
    """keys, candidate, because: the first n differently named titles of an explanation, each with its sign."""
    keys = [*keys, "candidate"]
    named = explained.join(items.select("item", _of(items, "_shown", lambda: titles.display_title(F.col("clean_title"))).alias("name")), "item")
    one = F.row_number().over(Window.partitionBy(*keys, F.lower("name")).orderBy("place"))
    named = named.withColumn("_one", one).where("_one = 1").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))).where(F.col("_n") <= n)
    sign = F.concat(F.when(F.col("contribution") > 0, F.lit("+")).otherwise(F.lit("-")), "name")
    return named.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", sign.alias("s")))), lambda x: x["s"]), ", ").alias("because"))


def titles_like(items: DataFrame, text: str) -> DataFrame:
    """items whose title holds the text literally, whatever the case."""
    return items.where(F.contains(F.lower("clean_title"), F.lit(text.lower())))
