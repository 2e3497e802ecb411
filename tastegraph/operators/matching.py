"""Titles and years against a catalogue: exact keys under year rules, then a year-blocked fuzzy pass.

films: any columns with film_id (a unique row id), title, year. catalogue: item, clean_title, year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import fuzzy, titles

EXACT, NEAR, UNDATED_FILM, UNDATED_ITEM, MISMATCH = "exact title+year", "exact title, year +/-1", "exact title, no year given", "exact title, catalogue has no year", "unique title, YEAR MISMATCH"


def title_index(catalogue: DataFrame) -> DataFrame:
    """key, item, item_year, entries: every key that the catalogue answers to with its years, the least item of each, and how many items (of any year) answer to that key.

    Items of one title and year are one row before keys are worked out: rules choose by key and year, then by the least item, so a title that thousands of
    items share isn't joined thousands of times."""
    same = catalogue.groupBy("clean_title", F.col("year").cast("int").alias("item_year")).agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("_n"))
    rows = same.select("item", "item_year", "_n", F.explode(titles.title_variants(F.col("clean_title"))).alias("key"))
    years = rows.groupBy("key", "item_year").agg(F.min("item").alias("item"), F.sum("_n").alias("_n"))
    return years.select("key", "item", "item_year", F.sum("_n").over(Window.partitionBy("key")).alias("entries"))


def asked_titles(films: DataFrame) -> DataFrame:
    """title, year: what films ask for, each once."""
    return films.select("title", F.col("year").cast("int").alias("year")).distinct()


def _same(found: DataFrame) -> tuple[DataFrame, Column]:
    """(what was found, under other names for title and year; the condition that it is about a row's title and year)."""
    named = found.withColumnsRenamed({"title": "_title", "year": "_year"})
    return named, (F.col("title") == F.col("_title")) & F.col("year").cast("int").eqNullSafe(F.col("_year"))


def each(films: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """films with item, item_year and method of their title and year; with ``how="inner"`` those that have one."""
    named, same = _same(found)
    return films.join(named, same, how).drop("_title", "_year")


def left_over(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Titles and years for which nothing was found."""
    named, same = _same(found.select("title", "year"))
    return asked.join(named, same, "left_anti")


def match_exact(films: DataFrame, index: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """film_id, item, item_year, method of films that a rule hits. Films of one title and year are looked up once."""
    return each(films, exact_titles(asked_titles(films), index, config), "inner").select("film_id", "item", "item_year", "method")


def exact_titles(asked: DataFrame, index: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """title, year, item, item_year, method of titles and years that a rule hits.

    Any rule on the first key beats every rule on the second. Within a key: same year; nearest year in tolerance; no year given and one
    entry; year given and the only entry undated; optionally the only entry whatever its year. Ties go to the least item."""
    met = asked.select("title", "year", F.posexplode(titles.title_keys(F.col("title"))).alias("key_place", "key")).join(index, "key")
    delta, one = F.abs(F.col("item_year") - F.col("year")), F.col("entries") == 1
    rule = (
        F.when(delta == 0, 1)
        .when(delta <= config.year_tolerance, 2)
        .when(F.col("year").isNull() & one, 3)
        .when(F.col("year").isNotNull() & F.col("item_year").isNull() & one, 4)
    )
    if not config.require_year_agreement:
        rule = rule.when(one, 5)
    best = Window.partitionBy("title", "year").orderBy("key_place", "rule", F.coalesce(delta, F.lit(0)), "item")
    names = F.element_at(F.array(*[F.lit(x) for x in (EXACT, NEAR, UNDATED_FILM, UNDATED_ITEM, MISMATCH)]), F.col("rule"))
    hits = met.withColumn("rule", rule).where(F.col("rule").isNotNull()).withColumn("_k", F.row_number().over(best)).where("_k = 1")
    return hits.select("title", "year", "item", "item_year", names.alias("method"))


def match_fuzzy(films: DataFrame, index: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """film_id, item, item_year, method of dated films whose first key is like a catalogue key of a near year."""
    return each(films, fuzzy_titles(asked_titles(films), index, config), "inner").select("film_id", "item", "item_year", "method")


def fuzzy_titles(titled: DataFrame, index: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """title, year, item, item_year, method of dated titles (title, year, each once) whose first key is like a catalogue key of a near year.

    The band of years is exploded into an equi-join, each distinct pair of keys is compared once, and pairs whose lengths exclude the threshold
    aren't compared at all. The best token-sort ratio wins if it reaches its threshold (ties: earlier year, then key); otherwise the best
    token-set ratio among keys of the very year."""
    t = config.year_tolerance
    asked = titled.where(F.col("year").isNotNull()).withColumn("asked", F.get(titles.title_keys(F.col("title")), F.lit(0))).where("asked IS NOT NULL")
    distinct = asked.select("asked", "year").distinct()
    pool = index.where("item_year IS NOT NULL").groupBy("key", "item_year").agg(F.min("item").alias("item"))
    band = distinct.withColumn("item_year", F.explode(F.sequence(F.col("year") - t, F.col("year") + t)))
    tokens = lambda c: F.split(c, " ")
    near = fuzzy.bound(F.col("asked"), F.col("key")) >= config.fuzzy_threshold
    # a set ratio above 66.7 without any token in common would need near-equal strings; it is computed where tokens meet or lengths allow
    within = F.arrays_overlap(tokens("asked"), tokens("key")) | (fuzzy.bound(F.col("asked"), F.col("key")) >= config.subset_threshold)
    # pairs that can reach neither threshold leave inside the join, before anything is shuffled
    met = band.join(pool, "item_year").where(near | ((F.col("item_year") == F.col("year")) & within))
    compared = met.select("asked", "key").distinct().withColumns({"near": near, "within": within})
    ask = lambda c: F.when(F.col(c), F.col("asked"))
    compared = compared.select("asked", "key", fuzzy.token_sort_ratio(ask("near"), F.col("key")).alias("by_sort"), fuzzy.token_set_ratio(ask("within"), F.col("key")).alias("by_set"))
    rows = met.join(compared, ["asked", "key"])
    kind = F.when(F.col("by_sort") >= config.fuzzy_threshold, 1).when((F.col("item_year") == F.col("year")) & (F.col("by_set") >= config.subset_threshold), 2)
    value = F.when(F.col("kind") == 1, F.col("by_sort")).otherwise(F.col("by_set"))
    best = Window.partitionBy("asked", "year").orderBy("kind", F.desc("value"), "item_year", "key")
    hits = rows.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("value", value).withColumn("_k", F.row_number().over(best)).where("_k = 1")
    if config.any_year_for_fuzzy:
        first = index.groupBy("key").agg(F.min(F.struct("item", "item_year")).alias("first"))
        free = hits.join(first, "key").withColumns({"item": F.when(F.col("kind") == 1, F.col("first.item")).otherwise(F.col("item")), "item_year": F.when(F.col("kind") == 1, F.col("first.item_year")).otherwise(F.col("item_year"))})
        hits = free.drop("first")
    name = F.concat(F.when(F.col("kind") == 1, F.lit("fuzzy sort ")).otherwise(F.lit("subset, exact year ")), F.bround("value", 0).cast("int").cast("string"))
    return asked.join(hits.select("asked", "year", "item", "item_year", name.alias("method")), ["asked", "year"]).select("title", "year", "item", "item_year", "method")


def found_titles(films: DataFrame, catalogue: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """title, year, item, item_year, method of what films ask for and the catalogue has: exact rules, then the fuzzy pass for the rest. It has at most a row for
    each different title and year, so it is worth writing before films are joined with it."""
    index, asked = title_index(catalogue), asked_titles(films)
    exact = exact_titles(asked, index, config)
    return exact.unionByName(fuzzy_titles(left_over(asked, exact), index, config))


def match(films: DataFrame, catalogue: DataFrame, config: MatchConfig = MatchConfig(), stats: DataFrame | None = None) -> DataFrame:
    """films with item, item_year (-9999 for an undated item), method and, with stats, n_ratings, mean_rating and residual; unmatched rows have nulls."""
    return matched(films, found_titles(films, catalogue, config), stats)


def matched(films: DataFrame, found: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """``match`` from what ``found_titles`` made."""
    out = each(films, found).withColumn("item_year", F.when(F.col("item").isNotNull(), F.coalesce("item_year", F.lit(-9999))))
    if stats is not None:
        out = out.join(stats.select("item", "n_ratings", "mean_rating"), "item", "left")
        if "rating" in films.columns:
            out = out.withColumn("residual", F.col("rating") - F.col("mean_rating"))
    return out


def coverage(films: DataFrame, since: int = 2024) -> DataFrame:
    """One row: n films from ``since`` on and their share of all (films without a year count as earlier)."""
    late = F.coalesce((F.col("year") >= since).cast("int"), F.lit(0))
    return films.agg(F.coalesce(F.sum(late), F.lit(0)).alias("n"), F.avg(late).alias("share"))


def profile_line(matched: DataFrame, top: int = 3, width: int = 30) -> DataFrame:
    """One row for one member: rated, matched, share, mean, spread, and the titles of the highest and lowest ratings (matched: title, rating, item, ord)."""

    def ends(order) -> DataFrame:
        first = matched.orderBy(order, "ord").limit(top).withColumn("_k", F.row_number().over(Window.orderBy(order, "ord")))  # of ``top`` rows
        return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.substring("title", 1, width).alias("t")))), lambda x: x["t"]), " · ").alias("titles"))

    hit = F.col("item").isNotNull()
    one = matched.agg(F.count(F.lit(1)).alias("rated"), F.count_if(hit).alias("matched"), F.avg(hit.cast("int")).alias("share"), F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("spread"))
    return one.join(ends(F.desc("rating")).withColumnRenamed("titles", "loved"), how="cross").join(ends(F.asc("rating")).withColumnRenamed("titles", "hated"), how="cross")


def report(matched: DataFrame) -> DataFrame:
    """method, n, share: how films were matched (``unmatched`` for the rest)."""
    by = matched.groupBy(F.coalesce("method", F.lit("unmatched")).alias("method")).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("method", "n", (F.col("n") / F.col("total")).alias("share"))
