"""Compound plans: recommendations in a mode, parameter sweeps, the offline build."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MODES, SWEEP, EvalConfig, MatchConfig, Mode, PresentationConfig, ProfileConfig, ScoringConfig, SimilarityConfig, StagingConfig
from ..operators import evaluation, matching, presentation, profile, ratings, scoring, similarity
from ..sources import staging
from ..sources.export import Export


def build(raw: DataFrame, staging: StagingConfig = StagingConfig(), config: SimilarityConfig = SimilarityConfig(), exclude_users: DataFrame | None = None, stats_exclude_users: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, stats) of raw ratings: filtered in two passes, similarities without ``exclude_users``.

    Statistics (popularity, mean, consensus) come from everybody unless ``stats_exclude_users``: with held-out users in them, evaluation leaks through the consensus term."""
    fact = ratings.unique_pairs(ratings.two_pass_filter(raw, staging))
    edges = similarity.build(fact, config, exclude_users)
    of = ratings.without_users(fact, exclude_users) if stats_exclude_users and exclude_users is not None else fact
    return edges, item_statistics(of, config)


def item_statistics(fact: DataFrame, config: SimilarityConfig = SimilarityConfig()) -> DataFrame:
    """item, n_ratings, mean_rating, z_mean in one aggregation over the ratings with their z-scores."""
    z = ratings.z_scores(fact, config.sigma_floor)
    n = F.count(F.lit(1))
    return z.groupBy("item").agg(n.cast("int").alias("n_ratings"), F.avg("rating").alias("mean_rating"), (F.avg("z") * n / (n + F.lit(float(config.consensus_shrinkage_lambda)))).alias("z_mean"))


def recommend(rated: DataFrame, edges: DataFrame, stats: DataFrame, items: DataFrame, mode: str | Mode = "balanced", n: int = 20, seen: DataFrame | None = None, config: ScoringConfig = ScoringConfig(), shown: PresentationConfig | None = PresentationConfig(), just_shorts: bool = False, user_scale: DataFrame | None = None, offered_before: DataFrame | None = None) -> DataFrame:
    """Each user's list: user, place, item, clean_title, year, rank_score, pred_z, pred_d, support, n_neighbours, n_ratings, because [, predicted_stars, crowd_stars].

    rated: user, item, z [, weight]. seen: user, item that must not be offered (everything watched). items: item, clean_title, year
    [, title_type]. shown None: no presentation filters. user_scale: user, mean, sigma for stars. offered_before: user, item that an earlier list offered, which
    aren't offered again (but don't count as started works).

    rated, edges and stats are read several times in one plan (scores, explanations): pass written tables, or what ``staging.cut`` makes."""
    spec = MODES[mode] if isinstance(mode, str) else mode
    items = items if "_work" in items.columns else presentation.keyed(items)
    config = replace(config, popularity_alpha=spec.alpha, min_support=config.min_support if spec.min_support is None else spec.min_support)
    # Items without evidence can't pass a positive support floor, so the users x catalogue grid isn't needed.
    away = seen if offered_before is None else offered_before.select("user", "item") if seen is None else seen.select("user", "item").unionByName(offered_before.select("user", "item")).distinct()
    found = scoring.score(rated, edges, stats, config, away, every=config.min_support <= 0).where("scoreable")
    found = presentation.popularity_window(found, spec.min_popularity, spec.max_popularity)
    offered = items
    if shown is not None and "title_type" in items.columns:
        offered = presentation.allowed_types(offered, shown)
        offered = presentation.only_shorts(offered, shown) if just_shorts else offered
    found = scoring.rank(found.join(offered, "item"), ["user"], "rank_score", "rank")
    if shown is None:
        kept = found.where(F.col("rank") <= n)
    else:
        started = None
        if shown.dedupe_against_seen and seen is not None:
            started = presentation.seen_works(seen.join(items.select("item", "_bases"), "item"))
        kept = presentation.diversify(found, n, shown, started)
    kept = staging.written(scoring.rank(kept, ["user"], "rank_score", "place"))  # read twice below
    why = presentation.because(scoring.explain(rated, edges, stats, kept, 12, config), items)
    kept = kept.join(why.withColumnRenamed("candidate", "item"), ["user", "item"], "left")
    extra = []
    if user_scale is not None:
        kept = kept.join(user_scale.select("user", "mean", "sigma"), "user")
        extra = [scoring.stars(F.col("pred_z"), F.col("mean"), F.col("sigma"), config.pred_gain).alias("predicted_stars"), scoring.stars(F.col("z_mean"), F.col("mean"), F.col("sigma")).alias("crowd_stars")]
    return kept.select("user", "place", "item", "clean_title", "year", "rank_score", "pred_z", "pred_d", "support", "n_neighbours", "n_ratings", "because", *extra)


def sections(rated: DataFrame, edges: DataFrame, stats: DataFrame, items: DataFrame, modes: Sequence[tuple[str, Mode]], n: int = 5, seen: DataFrame | None = None, shown: PresentationConfig | None = PresentationConfig()) -> DataFrame:
    """user, section, place, item, clean_title: one list after another, each without what an earlier one offered to that user. Each list is written before the
    next one reads it, so that plans don't grow with their number."""
    out, items = None, items if "_work" in items.columns else staging.cut(presentation.keyed(items))
    for name, mode in modes:
        before = None if out is None else out.select("user", "item").distinct()
        one = staging.cut(recommend(rated, edges, stats, items, mode, n, seen, shown=shown, offered_before=before).select("user", F.lit(name).alias("section"), "place", "item", "clean_title"))
        out = one if out is None else out.unionByName(one)
    return out


def removed(rated: DataFrame, edges: DataFrame, stats: DataFrame, items: DataFrame, config: ScoringConfig = ScoringConfig(), seen: DataFrame | None = None, shown: PresentationConfig = PresentationConfig()) -> DataFrame:
    """user, watched (known items that can't be offered), ranked (candidates before presentation), non_films (of these, of a denied type), weak (films below the
    floors of prediction or neighbours): one pass over the candidates."""
    found = scoring.score(rated, edges, stats, config, seen, every=config.min_support <= 0).where("scoreable").join(items.select("item", "title_type"), "item")
    denied = F.coalesce(F.col("title_type").isin(*shown.excluded_types()), F.lit(False)) if shown.drop_non_films else F.lit(False)
    floor = F.lit(False) if shown.min_predicted_z is None else F.coalesce(F.col("pred_z") < shown.min_predicted_z, F.lit(False))
    weak = floor | F.coalesce(F.col("n_neighbours") < shown.min_neighbours_to_show, F.lit(False))
    counted = found.groupBy("user").agg(F.count(F.lit(1)).alias("ranked"), F.count_if(denied).alias("non_films"), F.count_if(~denied & weak).alias("weak"))
    known = (rated if seen is None else seen).select("user", "item").distinct().groupBy("user").agg(F.count(F.lit(1)).alias("watched"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return known.join(counted, "user", "left").select("user", "watched", zero("ranked"), zero("non_films"), zero("weak"))


def neighbours_by_title(edges: DataFrame, stats: DataFrame, items: DataFrame, text: str, n: int = 10, shown: PresentationConfig | None = PresentationConfig()) -> DataFrame:
    """place, sim, item, clean_title of the n nearest (signed) of the most rated item whose title holds the text; other types than films leave after the cut."""
    hits = presentation.titles_like(items, text).join(stats.select("item", "n_ratings"), "item")
    top = hits.orderBy(F.desc("n_ratings"), "item").limit(1).select(F.col("item").alias("i"))
    near = edges.join(F.broadcast(top), "i").orderBy(F.desc(F.round("sim", 9)), "j").limit(n)  # one row is broadcast
    near = near.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("sim", 9)), "j")))  # of n rows
    offered = presentation.allowed_types(items, shown) if shown is not None and "title_type" in items.columns else items
    return near.join(offered.withColumnRenamed("item", "j"), "j").select("place", "sim", F.col("j").alias("item"), "clean_title")


def build_artefacts(spark: SparkSession, raw: DataFrame, out: str, staging_config: StagingConfig = StagingConfig(), config: SimilarityConfig = SimilarityConfig(), eval_config: EvalConfig = EvalConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, stats, held-out users), written under ``out`` and read back: users are drawn and written first, and the similarity is built without them."""
    fact = ratings.unique_pairs(ratings.two_pass_filter(raw, staging_config))
    staging.save_holdout(evaluation.eval_users(fact, eval_config), out)
    users = staging.load_holdout(spark, out)
    built_on = ratings.without_users(fact, users)
    ratings.assert_disjoint(built_on, users)
    staging.save_similarity(similarity.build(fact, config, users), item_statistics(fact, config), out)
    edges, stats, _ = staging.load_similarity(spark, out)
    return edges, stats, users


def profile_report(export: Export, catalogue: DataFrame, stats: DataFrame, config: ProfileConfig = ProfileConfig(), match_config: MatchConfig = MatchConfig(), since: int = 2024, out: str | None = None) -> dict[str, DataFrame]:
    """A member's export in tables: films, stats, matched (rated films with their items), watchlist (matched likewise), methods (of both), coverage, summary.

    ``out``: matches and misses are written there as CSV files."""
    one = lambda df: df.withColumn("user", F.lit(0).cast("long"))
    reviews = one(export.reviews) if "review" in export.reviews.columns else None
    films, scale = profile.profile(one(export.ratings), one(export.likes), reviews, config)
    numbered = lambda df: df.withColumn("film_id", F.col("ord"))
    matched = matching.match(numbered(films), catalogue, match_config, stats)
    watchlist = matching.match(numbered(export.watchlist), catalogue, match_config, stats)
    methods = matching.report(matched).withColumn("table", F.lit("rated")).unionByName(matching.report(watchlist).withColumn("table", F.lit("watchlist")))
    if out is not None:
        staging.save_report(matched.drop("warnings"), out)
    return {"films": films, "stats": scale, "matched": matched, "watchlist": watchlist, "methods": methods, "coverage": matching.coverage(films, since), "summary": profile.summary(films, scale)}


def sweep(rated: DataFrame, edges: DataFrame, stats: DataFrame, configs: Mapping[str, ScoringConfig] = SWEEP, config: EvalConfig = EvalConfig()) -> DataFrame:
    """One row for each configuration (see ``evaluation.sweep_table``), all over the same splits."""
    return evaluation.sweep_table(evaluation.sweep(evaluation.splits(rated, config), edges, stats, configs, config))
