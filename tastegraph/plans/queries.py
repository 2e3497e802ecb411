"""Registry of the engine's queries over the driver's tables. Values are rounded to six places; ``oracle`` has the SQL for the same names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import COMPARE, MODES, SWEEP, EvalConfig, MatchConfig, PresentationConfig, ProfileConfig, ScoringConfig, SimilarityConfig, StagingConfig
from ..functions import titles as T
from ..operators import evaluation, matching, presentation, profile, ratings, scoring, similarity
from ..sources import staging
from . import oracle, recommend, views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: The dense view has a hundred items, the sparse one thousands with few common raters: neighbours and shrinkage follow.
DENSE = SimilarityConfig(shrinkage_lambda=60.0, top_k_neighbours=50)
SPARSE = SimilarityConfig(shrinkage_lambda=2.0, top_k_neighbours=200)
#: Of the eligible users 300 are drawn, or a fifth where that is fewer, so that the similarity has somebody left to be built on.
EVAL = EvalConfig(holdout_share=0.2, holdout_min=20, holdout_max=100_000, repeats=2, ks=(10, 20))
#: High enough for both passes to drop something.
STAGING = StagingConfig(min_item_ratings=22, min_user_ratings=30)


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places. A zero keeps the sign of what was rounded, as it does in SQL engines that round in floating point (Spark goes by decimals, which have
    no negative zero): equal as a number, but not as a text."""
    kinds = dict(df.dtypes)

    def six(c: str) -> Column:
        value = F.round(F.col(c), 6)
        return F.when(value == 0, F.col(c) * F.lit(0.0)).otherwise(value) if kinds[c] == "double" else value

    return df.withColumns({c: six(c) for c in columns})


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return views.ratings_dense(spark, d)


def _edges(spark: SparkSession, d: str, config: SimilarityConfig = DENSE, exclude: DataFrame | None = None) -> DataFrame:
    return similarity.build(_dense(spark, d), config, exclude)


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return recommend.item_statistics(_dense(spark, d), DENSE)


def _rated(spark: SparkSession, d: str) -> DataFrame:
    """Every user's whole profile."""
    return ratings.z_scores(_dense(spark, d)).select("user", "item", "rating", "z")


def _ready(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, edges, statistics) as written tables: plans that read them several times build them once, and Spark knows how small the last two are."""
    dense = staging.written(_dense(spark, d))
    rated = staging.written(ratings.z_scores(dense).select("user", "item", "rating", "z"))
    return rated, staging.written(similarity.build(dense, DENSE)), staging.written(recommend.item_statistics(dense, DENSE))


def _listed(spark: SparkSession, d: str, stats: DataFrame) -> DataFrame:
    """The items that have ratings, with what lists need of their titles: all that a list can offer or a user have seen."""
    return staging.written(presentation.keyed(views.dense_items(spark, d).join(stats.select("item"), "item", "left_semi")))


# ratings


@query
def z_scores(spark, d):
    return rounded(ratings.z_scores(_dense(spark, d)).select("user", "item", "z"), "z")


@query
def user_stats(spark, d):
    return rounded(ratings.user_stats(_dense(spark, d)), "mean", "sigma_raw", "sigma")


@query
def two_pass_filter(spark, d):
    fact = views.ratings_sparse(spark, d)
    return ratings.two_pass_filter(fact, STAGING)


@query
def dense_index(spark, d):
    fact = staging.cut(ratings.two_pass_filter(staging.cut(views.ratings_sparse(spark, d)), STAGING))
    return ratings.index_ratings(fact)[0]


@query
def item_stats(spark, d):
    return rounded(ratings.item_stats(views.ratings_sparse(spark, d), views.catalogue(spark, d).select("item", "clean_title")), "mean_rating")


@query
def consensus_z(spark, d):
    return rounded(ratings.consensus(ratings.z_scores(_dense(spark, d)), DENSE), "z_mean")


@query
def popularity_quintiles(spark, d):
    stats = ratings.item_stats(views.ratings_sparse(spark, d))
    return stats.join(F.broadcast(ratings.popularity_cuts(stats))).select("item", "n_ratings", ratings.popularity_band().alias("quintile"))


# similarity


@query
def pair_similarity(spark, d):
    return rounded(similarity.pairs(similarity.vectors(_dense(spark, d), DENSE), DENSE), "sim")


@query
def pair_similarity_centered(spark, d):
    config = replace(DENSE, item_centered=True)
    return rounded(similarity.pairs(similarity.vectors(_dense(spark, d), config), config), "sim")


@query
def topk_neighbours(spark, d):
    return rounded(_edges(spark, d), "sim")


@query
def topk_neighbours_sparse(spark, d):
    return rounded(similarity.build(views.ratings_sparse(spark, d), SPARSE), "sim")


@query
def similarity_excluding_users(spark, d):
    fact = _dense(spark, d)
    users = evaluation.eval_users(fact, EVAL)
    ratings.assert_disjoint(ratings.without_users(fact, users), users)
    return rounded(_edges(spark, d, DENSE, users), "sim")


@query
def nearest_neighbours(spark, d):
    """The eight nearest by signed similarity of every item."""
    near = Window.partitionBy("i").orderBy(F.desc(F.round("sim", 9)), "j")
    place = _edges(spark, d).withColumn("place", F.row_number().over(near)).where("place <= 8")
    return rounded(place.join(views.dense_items(spark, d).select(F.col("item").alias("j"), "clean_title"), "j").select("i", "place", "j", "sim", "clean_title"), "sim")


# scoring


def _scores(spark, d, config: ScoringConfig) -> DataFrame:
    found = scoring.score(*_ready(spark, d), config)
    return rounded(found.select("user", "item", "pred_z", "pred_d", "support", "n_neighbours", "rank_score", "scoreable"), "pred_z", "pred_d", "support", "rank_score")


@query
def score_residual(spark, d):
    return _scores(spark, d, ScoringConfig())


@query
def score_legacy(spark, d):
    return _scores(spark, d, ScoringConfig(use_residual_input=False, rank_shrinkage_k=0.0))


@query
def score_pred_shrink(spark, d):
    return _scores(spark, d, ScoringConfig(pred_shrinkage_k=3.0, min_support=0.5, consensus_beta=0.5))


def _mode(spark, d, mode, **kw) -> DataFrame:
    rated, edges, stats = _ready(spark, d)
    scale = ratings.user_stats(rated)
    out = recommend.recommend(rated, edges, stats, _listed(spark, d, stats), mode, 10, rated.select("user", "item"), user_scale=scale, **kw)
    return rounded(out.drop("year"), "rank_score", "pred_z", "pred_d", "support", "predicted_stars", "crowd_stars")


@query
def recommend_balanced(spark, d):
    return _mode(spark, d, "balanced")


@query
def recommend_gem(spark, d):
    return _mode(spark, d, "gem")


@query
def recommend_blindspot(spark, d):
    return _mode(spark, d, replace(MODES["blindspot"], min_popularity=60))


@query
def recommend_unfiltered(spark, d):
    return _mode(spark, d, "balanced", shown=None)


@query
def explain(spark, d):
    rated, edges, stats = _ready(spark, d)
    wanted = scoring.rank(scoring.score(rated, edges, stats, every=False).where("scoreable"), ["user"], "rank_score", "rank").where("rank <= 3")
    return rounded(scoring.explain(rated, edges, stats, wanted.select("user", "item"), 5), "contribution")


@query
def predicted_stars(spark, d):
    rated, edges, stats = _ready(spark, d)
    found = scoring.score(rated, edges, stats, every=False).where("scoreable")
    scale = ratings.user_stats(rated)
    rows = found.join(scale, "user").select("user", "item", scoring.stars(F.col("pred_z"), F.col("mean"), F.col("sigma"), 1.17).alias("stars"), scoring.stars(F.col("z_mean"), F.col("mean"), F.col("sigma")).alias("crowd"))
    return rounded(rows, "stars", "crowd")


@query
def leave_one_out(spark, d):
    rated = _rated(spark, d)
    best = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("rating"), "item"))
    targets = rated.withColumn("_r", best).where("_r = 1").select("user", "item")
    return evaluation.leave_one_out(rated.select("user", "item", "z"), targets, _edges(spark, d), _stats(spark, d))


#: Types that the driver's items have, denied as television is among real titles.
SHOWN = PresentationConfig(drop_title_types=("ECONOMY", "PROMO"))
MODES_HERE = (("balanced", MODES["balanced"]), ("gem", MODES["gem"]), ("blindspot", replace(MODES["blindspot"], min_popularity=60)))


@query
def sections(spark, d):
    """Three lists of five, none of which repeats what an earlier one offered."""
    rated, edges, stats = _ready(spark, d)
    return recommend.sections(rated, edges, stats, _listed(spark, d, stats), MODES_HERE, 5, rated.select("user", "item"), SHOWN)


@query
def filter_counters(spark, d):
    rated, edges, stats = _ready(spark, d)
    return recommend.removed(rated, edges, stats, views.dense_items(spark, d).join(stats.select("item"), "item", "left_semi"), shown=SHOWN)


@query
def title_neighbours(spark, d):
    """Neighbours of the most rated item whose title holds a text."""
    return rounded(recommend.neighbours_by_title(_edges(spark, d), _stats(spark, d), views.dense_items(spark, d), "WIDGET", 10, SHOWN), "sim")


@query
def smoke_neighbours(spark, d):
    """Of the build without the held-out users: the eight nearest of three items that everybody can judge."""
    fact = _dense(spark, d)
    edges = staging.cut(_edges(spark, d, DENSE, evaluation.eval_users(fact, EVAL)))
    items, out = views.dense_items(spark, d).select("item", "clean_title"), None
    for probe in (1, 2, 3):
        one = similarity.neighbours(edges, items, probe).select(F.lit(probe).cast("long").alias("probe"), F.col("j").alias("item"), "sim", "clean_title")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "sim")


@query
def top_consensus(spark, d):
    top = ratings.top_consensus(_stats(spark, d), views.dense_items(spark, d))
    return rounded(top.select("place", "item", "clean_title", "n_ratings", "z_mean"), "z_mean")


@query
def fact_summary(spark, d):
    return ratings.fact_summary(views.ratings_sparse(spark, d))


# titles


def _texts(spark, d) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", "text")


@query
def norm_title(spark, d):
    return _texts(spark, d).select("doc_id", T.norm_title(F.col("text")).alias("key"))


def _titles(spark, d) -> DataFrame:
    return views.dense_items(spark, d)


@query
def title_variants(spark, d):
    return _titles(spark, d).select("item", F.array_join(T.title_variants(F.col("clean_title")), "|").alias("variants"))


@query
def title_year_split(spark, d):
    both = F.concat(F.col("clean_title"), F.when(F.col("item") % 3 != 0, F.concat(F.lit(" ("), F.col("year"), F.lit(")"))).otherwise(F.lit(" ()")))
    title, year = T.split_year(both)
    return _titles(spark, d).select("item", title.alias("title"), year.alias("title_year"))


@query
def display_title(spark, d):
    return _titles(spark, d).select("item", T.display_title(F.col("clean_title")).alias("shown"))


@query
def work_key(spark, d):
    return _titles(spark, d).select("item", T.work_key(F.col("clean_title"), F.col("year")).alias("work"))


@query
def series_key(spark, d):
    return _titles(spark, d).select("item", T.series_key(F.col("clean_title")).alias("series"))


@query
def base_titles(spark, d):
    return _titles(spark, d).select("item", F.array_join(T.base_titles(F.col("clean_title")), "|").alias("bases"))


@query
def title_search(spark, d):
    return presentation.titles_like(_titles(spark, d), "wIdGeT (").select("item", "clean_title")


# matching


@query
def match_exact(spark, d):
    index = matching.title_index(views.catalogue(spark, d))
    return matching.match_exact(views.films(spark, d), index).select("film_id", "item", "item_year", "method")


@query
def match_legacy(spark, d):
    index = matching.title_index(views.catalogue(spark, d))
    return matching.match_exact(views.films(spark, d), index, MatchConfig(year_tolerance=0, require_year_agreement=False))


def _fuzzy(spark, d) -> DataFrame:
    index, films = matching.title_index(views.catalogue(spark, d)), views.films(spark, d)
    asked = matching.asked_titles(films)
    found = staging.written(matching.fuzzy_titles(matching.left_over(asked, matching.exact_titles(asked, index)), index))
    return matching.each(films, found, "inner").select("film_id", "item", "item_year", "method")


@query
def match_fuzzy(spark, d):
    return _fuzzy(spark, d)


def _matched(spark, d, stats: bool = False) -> DataFrame:
    """Films with what they match; ``stats``: and with the statistics of these items, for which all ratings of theirs are read, and no other item's."""
    films = views.films(spark, d)
    found = staging.written(matching.found_titles(films, views.catalogue(spark, d)))
    if not stats:
        return matching.matched(films, found)
    of = views.ratings_sparse(spark, d).join(found.select("item").distinct(), "item", "left_semi")
    return matching.matched(films, found, ratings.item_stats(of))


@query
def match_films(spark, d):
    return rounded(_matched(spark, d, stats=True).select("film_id", "item", "item_year", "method", "n_ratings", "mean_rating", "residual"), "mean_rating", "residual")


@query
def match_report(spark, d):
    return rounded(matching.report(_matched(spark, d)), "share")


@query
def coverage_after(spark, d):
    """How many of an export's films are from a late year, and their share."""
    return rounded(matching.coverage(views.films(spark, d), 1995), "share")


@query
def watchlist_match(spark, d):
    """How an export's ratings and its watchlist (every fourth film here) are matched."""
    found = _matched(spark, d)
    both = matching.report(found).withColumn("table", F.lit("rated")).unionByName(matching.report(found.where("film_id % 4 = 0")).withColumn("table", F.lit("watchlist")))
    return rounded(both.select("table", "method", "n", "share"), "share")


@query
def profile_line(spark, d):
    return rounded(matching.profile_line(_matched(spark, d)), "share", "mean", "spread")


# profiles


def _members(spark, d) -> DataFrame:
    """Many members' dated ratings: a customer's orders, priced, as titled films."""
    o = views.table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("user"),
        F.concat(F.lit("Order "), (F.col("o_orderkey") % 50).cast("string")).alias("title"),
        F.when(F.col("o_orderkey") % 9 != 0, F.year("o_orderdate")).alias("year"),
        F.greatest(F.lit(0.5), F.least(F.lit(5.0), F.round(F.col("o_totalprice") / 50000) / 2)).alias("rating"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate").cast("date")).alias("logged_date"),
        F.col("o_orderkey").alias("ord"),
        "o_orderstatus",
        "o_orderpriority",
    )


def _profile(spark, d, config=ProfileConfig()):
    rows = _members(spark, d)
    likes = rows.where("o_orderstatus = 'F'").select("user", "title", "year")
    reviews = rows.where("o_orderpriority LIKE '1%'").select("user", "title", "year", F.when(F.col("ord") % 2 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("review"))
    return profile.profile(rows.drop("o_orderstatus", "o_orderpriority"), likes, reviews, config)


@query
def profile_films(spark, d):
    films, _ = _profile(spark, d, ProfileConfig(use_likes=True))
    return rounded(films.select("user", "title", "year", "rating", "z", "weight", "is_liked", "has_review"), "z", "weight")


@query
def profile_stats(spark, d):
    _, stats = _profile(spark, d)
    return rounded(stats.select("user", "n", "mean", "sigma_raw", "sigma", "reference_date", F.size("warnings").cast("long").alias("n_warnings")), "mean", "sigma_raw", "sigma")


@query
def recency_weight(spark, d):
    w = Window.partitionBy("user")
    age = F.unix_seconds(F.max("logged_date").over(w).cast("timestamp")) - F.unix_seconds(F.col("logged_date").cast("timestamp"))
    rows = _members(spark, d).where("logged_date IS NOT NULL").select("user", "ord", profile.recency_weight(age, 3.0).alias("weight"))
    return rounded(rows, "weight")


@query
def bulk_import(spark, d):
    return rounded(profile.bulk_import(_members(spark, d)), "top_share")


@query
def liked_reviewed(spark, d):
    films, _ = _profile(spark, d)
    return films.groupBy("user").agg(F.sum(F.col("is_liked").cast("long")).alias("liked"), F.sum(F.col("has_review").cast("long")).alias("reviewed"))


@query
def seen_union(spark, d):
    rows = _members(spark, d)
    parts = [rows.where(F.col("o_orderstatus") == s) for s in ("O", "F", "P")]
    return profile.seen_titles(parts)


@query
def export_summary(spark, d):
    """Counts and rating moments of a whole export, one row."""
    from ..sources.export import summary_row

    return rounded(summary_row(_members(spark, d)), "rating_mean", "rating_stdev")


@query
def profile_extremes(spark, d):
    films, _ = _profile(spark, d)
    return rounded(profile.extremes(films, 3), "z")


@query
def perfect_films(spark, d):
    films, _ = _profile(spark, d)
    return profile.rated_exactly(films).select("user", "place", "title", "year", "rating")


@query
def profile_summary(spark, d):
    out = profile.summary(*_profile(spark, d)).withColumn("n_warnings", F.size("warnings").cast("long")).drop("warnings")
    return rounded(out, "mean", "sigma_raw", "sigma", "weight_min", "weight_median", "weight_max")


# presentation


@query
def type_filter(spark, d):
    items = views.catalogue(spark, d).drop("title_type")
    types = views.catalogue(spark, d).where(F.col("item") % 3 != 0).select(F.when(F.col("item") % 2 == 0, F.lpad("catalogue_id", 7, "0")).otherwise(F.col("catalogue_id")).alias("catalogue_id"), "title_type")
    config = PresentationConfig(drop_title_types=("ECONOMY", "PROMO"), short_type="SMALL", include_shorts=False)
    return presentation.allowed_types(presentation.typed(items, types), config).select("item", "title_type")


@query
def only_shorts(spark, d):
    return presentation.only_shorts(views.catalogue(spark, d), PresentationConfig(short_type="SMALL")).select("item")


@query
def popularity_window(spark, d):
    stats = ratings.item_stats(views.ratings_sparse(spark, d))
    return presentation.popularity_window(stats, 25, 35).select("item", "n_ratings")


@query
def diversify(spark, d):
    ranked = _titles(spark, d).withColumn("user", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("rank", F.md5(F.concat_ws(":", F.col("user").cast("string"), F.col("item").cast("string"))))
    seen = presentation.seen_works(ranked.where("rank < '02'").select("user", "clean_title"))
    return presentation.diversify(ranked, 25, PresentationConfig(), seen).select("user", "item")


# evaluation


def _held(spark, d, config=ScoringConfig()):
    fact = _dense(spark, d)
    users = evaluation.eval_users(fact, EVAL)
    rated, scale = evaluation.as_profiles(ratings.z_scores(fact), users)
    stats = _stats(spark, d)
    return evaluation.held_out(evaluation.splits(rated, EVAL), _edges(spark, d, DENSE, users), stats, config, None, EVAL), stats, scale


@query
def eval_users(spark, d):
    return evaluation.eval_users(_dense(spark, d), EVAL)


@query
def holdout_split(spark, d):
    z = ratings.z_scores(_dense(spark, d))
    return evaluation.splits(z, EVAL).select("user", "split", "item", "test")


@query
def baselines(spark, d):
    rows, stats, _ = _held(spark, d)
    return rounded(evaluation.observations(rows, stats), "percentile")


@query
def ranking_metrics(spark, d):
    rows, stats, _ = _held(spark, d)
    out = evaluation.ranking_metrics(evaluation.observations(rows, stats), rows, EVAL)
    return rounded(out, *[f"{m}_{k}" for m in ("recall", "ndcg") for k in EVAL.ks], "median_percentile", "best_percentile")


@query
def rating_error(spark, d):
    rows, _, scale = _held(spark, d)
    return rounded(evaluation.rating_error(rows, scale), "mae", "rmse", "mae_trivial")


@query
def pooled_error(spark, d):
    """Errors of all evaluated users, averaged over splits and then over users."""
    fact = _dense(spark, d)
    users = evaluation.eval_users(fact, EVAL)
    _, errors = evaluation.evaluate_users(ratings.z_scores(fact), users, _edges(spark, d, DENSE, users), _stats(spark, d), config=EVAL, repeats=EVAL.repeats)
    return rounded(evaluation.pooled_error(errors), "mae", "rmse", "mae_trivial")


@query
def strata(spark, d):
    rows, stats, _ = _held(spark, d)
    return rounded(evaluation.strata(evaluation.observations(rows, stats)), "median_percentile")


@query
def split_average(spark, d):
    rows, stats, _ = _held(spark, d)
    return rounded(evaluation.split_average(evaluation.observations(rows, stats), EVAL.repeats), "median_percentile")


@query
def pooled_table(spark, d):
    rows, stats, _ = _held(spark, d)
    return rounded(evaluation.pooled_table(evaluation.observations(rows, stats)), "Q1", "Q2", "Q3", "Q4", "Q5", "ALL")


@query
def pooled_table_rankable(spark, d):
    rows, stats, _ = _held(spark, d, ScoringConfig(min_support=oracle.RANKABLE_FLOOR))
    return rounded(evaluation.pooled_table(evaluation.observations(rows, stats), scoreable_only=True), "Q1", "Q2", "Q3", "Q4", "Q5", "ALL")


def _swept(spark, d, configs) -> DataFrame:
    fact = _dense(spark, d)
    users = evaluation.eval_users(fact, EVAL)
    rated, _ = evaluation.as_profiles(ratings.z_scores(fact), users)
    return rounded(recommend.sweep(rated, staging.cut(_edges(spark, d, DENSE, users)), staging.cut(_stats(spark, d)), configs, EVAL), "rankable", "Q1", "Q2", "Q3", "Q4", "Q5", "ALL", "Q1_3")


@query
def config_sweep(spark, d):
    """Nine settings over the same splits."""
    return _swept(spark, d, SWEEP)


@query
def config_compare(spark, d):
    """The old scorer and three of the new one over the same splits."""
    return _swept(spark, d, COMPARE)


# streaming


@query
def streaming_item_stats(spark, d):
    """Item statistics kept up by a stream over the events, once it has read everything."""
    from ..streaming.item_stats import drained

    return rounded(drained(spark, d), "mean_value")
