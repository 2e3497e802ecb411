"""Offline evaluation: repeated hold-outs of many users in one plan, baselines, ranking metrics, error, popularity strata, pooling.

Keys are (user, split); splits are ordered by md5, so every engine that has md5 draws the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EvalConfig, ScoringConfig
from . import scoring
from .profile import keep_first
from .ratings import popularity_band, popularity_cuts, user_stats

KEYS = ["user", "split"]
#: method name -> (column that it ranks by, value of a missing one)
METHODS = {"item-item CF": ("rank_score", None), "by consensus": ("mean_rating", -1.0), "by popularity": ("n_ratings", 0.0), "random": ("random", None)}


def draw(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def eval_users(ratings: DataFrame, config: EvalConfig = EvalConfig(), n: int | None = None) -> DataFrame:
    """n users (sorted) whose number of ratings lies in the eligible window, drawn by hash; ValueError if there are fewer.

    Without ``n``: ``holdout_users``, or ``holdout_share`` of those that are eligible (rounded up) if that is set and fewer."""
    asked, n = n, config.holdout_users if n is None else n
    counts = ratings.groupBy("user").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(config.holdout_min, config.holdout_max))
    if asked is None and config.holdout_share is not None:
        n = min(n, math.ceil(counts.count() * config.holdout_share))
    picked = counts.withColumn("_d", draw(config.seed, "user")).orderBy("_d", "user").limit(n).select("user")
    if (found := picked.count()) < n:
        raise ValueError(f"only {found} users have {config.holdout_min} to {config.holdout_max} ratings; {n} were asked for")
    return picked.orderBy("user")


def splits(rated: DataFrame, config: EvalConfig = EvalConfig(), repeats: int | None = None) -> DataFrame:
    """rated (user, item, rating, z [, weight, ord]) once for each split, with ``test``: a random fifth (rounded half to even, one at least)."""
    order = ["ord"] if "ord" in rated.columns else []
    rows = keep_first(rated.where(F.col("item").isNotNull()), ["user", "item"], *order, "rating")
    rows = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit((repeats or config.repeats) - 1))))
    w = Window.partitionBy(*KEYS)
    tests = F.greatest(F.bround(F.count(F.lit(1)).over(w) * F.lit(config.holdout_frac), 0), F.lit(1))
    place = F.row_number().over(w.orderBy(draw(config.seed, "split", "user", "item"), "item"))
    return rows.withColumn("test", place <= tests)


def held_out(halves: DataFrame, edges: DataFrame, stats: DataFrame, scoring_config: ScoringConfig = ScoringConfig(), exclude: DataFrame | None = None, config: EvalConfig = EvalConfig()) -> DataFrame:
    """One row for each candidate of each (user, split): its place under each method, and whether it is a relevant held-out item.

    Candidates are all items but the training ones (and ``exclude``, less the held-out items themselves). Columns: user, split, item, pred_z,
    scoreable, n_ratings, relevant, rating (of held-out items), candidates, rank_<k> for the k-th of METHODS."""
    train, test = halves.where("NOT test"), halves.where("test")
    if exclude is not None:
        exclude = exclude.join(test.select(*KEYS, "item"), [k for k in KEYS if k in exclude.columns] + ["item"], "left_anti") if "split" in exclude.columns else test.select(*KEYS).distinct().join(exclude, "user").join(test.select(*KEYS, "item"), [*KEYS, "item"], "left_anti")
    scored = scoring.score(train, edges, stats, scoring_config, exclude, KEYS)
    rows = _answered(scored, test, config)
    rows = rows.withColumn("random", -F.conv(F.substring(draw(config.seed, "split", "user", "item"), 1, 12), 16, 10).cast("double"))
    for k, (by, fill) in enumerate(METHODS.values()):
        rows = scoring.rank(rows, KEYS, by, f"rank_{k}", fill)
    return rows.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy(*KEYS)))


def _answered(scored: DataFrame, test: DataFrame, config: EvalConfig) -> DataFrame:
    """Candidates with ``rating`` (of held-out items) and ``relevant``."""
    answers = test.select(*KEYS, "item", "rating", (F.col("z") >= config.relevant_z).alias("relevant"))
    return scored.join(answers, [*KEYS, "item"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def sweep(halves: DataFrame, edges: DataFrame, stats: DataFrame, configs: Mapping[str, ScoringConfig], config: EvalConfig = EvalConfig()) -> DataFrame:
    """config, user, split, item, quintile, percentile, scoreable of the relevant held-out items under every configuration.

    A candidate's sums of evidence depend on a configuration only through ``use_residual_input``: they are joined and aggregated once for each of its two
    values, and every configuration is one more struct of a candidate's row."""
    train, test = halves.where("NOT test"), halves.where("test")
    out = None
    for residual in (True, False):
        mine = {name: c for name, c in configs.items() if c.use_residual_input == residual}
        if not mine:
            continue
        found = scoring.evidence(scoring.input_values(train, stats, next(iter(mine.values()))), edges, KEYS)
        pool = scoring.candidates(train, found, stats, None, KEYS).join(stats.select("item", "n_ratings", "z_mean"), "item").join(F.broadcast(scoring.median_popularity(stats)))
        each = []
        for name, c in mine.items():
            t = scoring.terms(c, F.col("num"), F.col("den"), F.col("z_mean"), F.col("n_ratings"), F.col("median_n"))
            each.append(F.struct(F.lit(name).alias("config"), t["rank_score"].alias("rank_score"), t["scoreable"].alias("scoreable")))
        rows = _answered(pool, test, config).withColumn("c", F.explode(F.array(*each))).select(*KEYS, "item", "n_ratings", "relevant", "c.*")
        rows = scoring.rank(rows, ["config", *KEYS], "rank_score", "rank").withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("config", *KEYS)))
        out = rows if out is None else out.unionByName(rows)
    found = out.where("relevant").join(F.broadcast(popularity_cuts(stats)))
    return found.select("config", *KEYS, "item", popularity_band().alias("quintile"), (1 - (F.col("rank") - 1) / F.greatest(F.col("candidates") - 1, F.lit(1))).alias("percentile"), "scoreable")


def sweep_table(seen: DataFrame) -> DataFrame:
    """config, n, rankable, Q1..Q5 (median percentiles), ALL, Q1_3 (mean of those of Q1 to Q3 that there are)."""
    level = seen.withColumn("quintile", F.explode(F.array(F.col("quintile"), F.lit("ALL"))))
    med = level.groupBy("config").pivot("quintile", ["Q1", "Q2", "Q3", "Q4", "Q5", "ALL"]).agg(F.median("percentile"))
    share = seen.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("scoreable").cast("int")).alias("rankable"))
    return share.join(med, "config").withColumn("Q1_3", mean_of("Q1", "Q2", "Q3"))


def mean_of(*columns: str) -> Column:
    """The mean of the columns that aren't null; null if all are."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def observations(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """user, split, method, quintile, rank, candidates, percentile, scoreable: relevant items only, under every method."""
    place = F.explode(F.array(*[F.struct(F.lit(name).alias("method"), F.col(f"rank_{k}").alias("rank")) for k, name in enumerate(METHODS)]))
    found = rows.where("relevant").join(F.broadcast(popularity_cuts(stats))).select(*KEYS, "item", popularity_band().alias("quintile"), "scoreable", "candidates", place.alias("m"))
    return found.select(*KEYS, "item", "m.method", "quintile", "m.rank", "candidates", (1 - (F.col("m.rank") - 1) / F.greatest(F.col("candidates") - 1, F.lit(1))).alias("percentile"), "scoreable")


def ranking_metrics(seen: DataFrame, pairs: DataFrame, config: EvalConfig = EvalConfig()) -> DataFrame:
    """user, split, method, n_relevant, recall_k, ndcg_k, median_percentile, best_percentile.

    ``pairs``: all (user, split); those without a relevant item get zeros."""
    at = F.col("rank")
    sums = []
    for k in config.ks:
        sums += [F.sum(F.when(at <= k, 1.0).otherwise(0.0)).alias(f"_hit_{k}"), F.sum(F.when(at <= k, 1 / F.log2(at + F.lit(1.0))).otherwise(0.0)).alias(f"_dcg_{k}")]
    by = seen.groupBy(*KEYS, "method").agg(F.count(F.lit(1)).alias("n_relevant"), F.median("percentile").alias("median_percentile"), F.max("percentile").alias("best_percentile"), *sums)
    grid = pairs.select(*KEYS).distinct().withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS])))
    rows = grid.join(by, [*KEYS, "method"], "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    out = []
    for k in config.ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + F.lit(1.0)))
        out += [F.coalesce(F.col(f"_hit_{k}") / F.greatest("n_relevant", F.lit(1)), F.lit(0.0)).alias(f"recall_{k}"), F.coalesce(F.col(f"_dcg_{k}") / ideal, F.lit(0.0)).alias(f"ndcg_{k}")]
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.select(*KEYS, "method", F.col("n_relevant").cast("long").alias("n_relevant"), *out, zero("median_percentile"), zero("best_percentile"))


def rating_error(rows: DataFrame, user_stats: DataFrame, scoring_config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """user, split, n, mae, rmse, mae_trivial over held-out ratings that the engine would rank; user_stats: user, mean, sigma."""
    known = rows.where("rating IS NOT NULL AND scoreable").join(user_stats.select("user", "mean", "sigma"), "user")
    err = scoring.stars(F.col("pred_z"), F.col("mean"), F.col("sigma"), scoring_config.pred_gain) - F.col("rating")
    return known.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(F.col("mean") - F.col("rating"))).alias("mae_trivial"))


def strata(seen: DataFrame) -> DataFrame:
    """user, method, quintile, n, median_percentile: medians of splits, averaged with their sizes as weights."""
    each = seen.groupBy(*KEYS, "method", "quintile").agg(F.count(F.lit(1)).alias("n"), F.median("percentile").alias("m"))
    return each.groupBy("user", "method", "quintile").agg(F.sum("n").alias("n"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("median_percentile"))


def split_average(seen: DataFrame, repeats: int) -> DataFrame:
    """user, method, quintile, median_percentile averaged over all splits, a split without that quintile counting 0 (biased low for rare
    quintiles; kept for comparison, pooled medians are the figures to report)."""
    each = seen.groupBy(*KEYS, "method", "quintile").agg(F.median("percentile").alias("m"))
    return each.groupBy("user", "method", "quintile").agg((F.sum("m") / F.lit(float(repeats))).alias("median_percentile"))


def pooled_table(seen: DataFrame, scoreable_only: bool = False) -> DataFrame:
    """row, Q1..Q5, ALL: median percentile of each method, then ``n`` and ``rankable`` (share that the engine could rank).

    One grouping-sets pass gives quintiles and the total."""
    base = seen.where("scoreable") if scoreable_only else seen
    level = lambda df: df.withColumn("quintile", F.explode(F.array(F.col("quintile"), F.lit("ALL"))))
    med = level(base).groupBy(F.col("method").alias("row"), "quintile").agg(F.median("percentile").alias("v"))
    # The share is of all observations, rankable or not; where nothing is, the table is empty.
    counted = F.sum(F.col("scoreable").cast("int") if scoreable_only else F.lit(1)).cast("double")
    one = level(seen.where(F.col("method") == METHODS_FIRST)).groupBy("quintile").agg(F.nullif(counted, F.lit(0.0)).alias("n"), F.avg(F.col("scoreable").cast("int")).alias("rankable"))
    if scoreable_only:
        one = one.join(base.select(F.lit(True).alias("_any")).limit(1), how="cross").drop("_any")
    extra = one.select(F.explode(F.array(F.struct(F.lit("n").alias("row"), F.col("n").alias("v")), F.struct(F.lit("rankable").alias("row"), F.col("rankable").alias("v")))).alias("x"), "quintile").select("x.row", "quintile", "x.v")
    return med.unionByName(extra).groupBy("row").pivot("quintile", ["Q1", "Q2", "Q3", "Q4", "Q5", "ALL"]).agg(F.first("v"))


METHODS_FIRST = next(iter(METHODS))


def pooled_error(errors: DataFrame) -> DataFrame:
    """mae, rmse, mae_trivial averaged over a user's splits, then over users."""
    c = ["mae", "rmse", "mae_trivial"]
    return errors.groupBy("user").agg(*[F.avg(x).alias(x) for x in c]).agg(*[F.avg(x).alias(x) for x in c], F.count(F.lit(1)).alias("users"))


def as_profiles(ratings: DataFrame, users: DataFrame, sigma_floor: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rated with flat weights, user, mean, sigma) of some users of the corpus, shaped like members' profiles; ratings: user, item, rating, z."""
    rated = ratings.join(users, "user", "left_semi").withColumn("weight", F.lit(1.0))
    return rated, user_stats(rated, sigma_floor).select("user", "mean", "sigma")


def evaluate_users(ratings: DataFrame, users: DataFrame, edges: DataFrame, stats: DataFrame, scoring_config: ScoringConfig = ScoringConfig(), config: EvalConfig = EvalConfig(), repeats: int = 2) -> tuple[DataFrame, DataFrame]:
    """(observations, errors) of many users: each is a profile with flat weights. ratings: user, item, rating, z."""
    rated, scale = as_profiles(ratings, users)
    rows = held_out(splits(rated, config, repeats), edges, stats, scoring_config, None, config)
    return observations(rows, stats), rating_error(rows, scale, scoring_config)


def leave_one_out(rated: DataFrame, targets: DataFrame, edges: DataFrame, stats: DataFrame, scoring_config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """user, target, rank, candidates: the place of each hidden (user, item) among all items that its user hasn't rated, and itself."""
    keys = ["user", "target"]
    asked = targets.select("user", F.col("item").alias("target"))
    rest = rated.join(asked, "user").where(F.col("item") != F.col("target"))
    found = scoring.rank(scoring.score(rest, edges, stats, scoring_config, None, keys), keys, "rank_score", "rank")
    found = found.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return found.where(F.col("item") == F.col("target")).select(*keys, "rank", "candidates")
