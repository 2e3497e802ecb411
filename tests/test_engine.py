"""Numeric invariants of ratings, similarity, scoring and evaluation on a miniature world of two camps."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tastegraph.config import EvalConfig, PresentationConfig, ScoringConfig, SimilarityConfig, StagingConfig
from tastegraph.operators import evaluation, presentation, profile, ratings, scoring, similarity
from tastegraph.plans import recommend

SIM = SimilarityConfig(shrinkage_lambda=5.0, top_k_neighbours=12)
SCORE = ScoringConfig(min_support=0.0)


@pytest.fixture(scope="module")
def world(spark):
    """80 users, 13 items: half like items 0-5, half like 6-11, all like 12; the noise is a hash."""
    noise = lambda u, i: ((u * 2654435761 + i * 40503) % 1000 / 1000 - 0.5) * 0.8
    rows = []
    for u in range(80):
        for i in range(13):
            level = 4.5 if i == 12 else 4.2 if (i < 6) == (u < 40) else 2.0
            rows.append((u, i, min(5.0, max(0.5, round(2 * (level + noise(u, i))) / 2))))
    fact = spark.createDataFrame(rows, "user long, item long, rating double").cache()
    edges = similarity.build(fact, SIM).cache()
    stats = recommend.item_statistics(fact, SIM).cache()
    return fact, edges, stats


def _rated(spark, values, user=1):
    return spark.createDataFrame([(user, i, float(z)) for i, z in values], "user long, item long, z double")


def test_camps_are_apart(world):
    sims = {(r.i, r.j): r.sim for r in world[1].collect()}
    assert sims[0, 1] > 0.3 > 0 > sims[0, 7]
    assert all(i != j for i, j in sims)
    assert all(sims[i, j] == pytest.approx(sims[j, i]) for i, j in sims if (j, i) in sims)


def test_thin_evidence_is_shrunk(spark):
    rows = [(u, i, float(r)) for u in range(3) for i, r in ((0, 5), (1, 5), (2, 1))] + [(u, 2, 3.0) for u in range(3, 60)]
    fact = spark.createDataFrame(rows, "user long, item long, rating double")
    sim = lambda lam: {(r.i, r.j): r.sim for r in similarity.build(fact, SimilarityConfig(shrinkage_lambda=lam)).collect()}[0, 1]
    assert sim(0.0) == pytest.approx(1.0)
    assert sim(60.0) == pytest.approx(3 / 63)


def test_top_k_bounds_neighbours(world):
    few = similarity.build(world[0], replace(SIM, top_k_neighbours=3)).groupBy("i").count()
    assert few.agg(F.max("count")).first()[0] == 3


def test_average_user_gets_consensus(spark, world):
    _, edges, stats = world
    rated = stats.where("item < 9").select(F.lit(1).cast("long").alias("user"), "item", F.col("z_mean").alias("z"))
    for r in scoring.score(rated, edges, stats, SCORE).collect():
        assert abs(r.pred_d) < 1e-6 and r.pred_z == pytest.approx(r.z_mean)


def test_members_of_a_camp_and_exclusion(spark, world):
    _, edges, stats = world
    rated = _rated(spark, [(0, 1.2), (1, 1.1), (2, 1.3), (6, -1.2), (7, -1.1), (8, -1.3)])
    got = {r["item"]: r for r in scoring.score(rated, edges, stats, SCORE).collect()}
    assert set(got) == {3, 4, 5, 9, 10, 11, 12}
    assert sum(got[i].pred_z for i in (3, 4, 5)) > sum(got[i].pred_z for i in (9, 10, 11))
    seen = spark.createDataFrame([(1, 3)], "user long, item long")
    assert 3 not in {r["item"] for r in scoring.score(rated, edges, stats, SCORE, seen).collect()}


def test_consensus_weight_moves_a_darling(spark, world):
    _, edges, stats = world
    stats = stats.withColumn("z_mean", F.when(F.col("item") == 11, 5.0).otherwise(F.col("z_mean")))
    rated = _rated(spark, [(0, 1.2), (1, 1.1), (6, -1.2)])

    def place(beta):
        found = scoring.score(rated, edges, stats, replace(SCORE, consensus_beta=beta))
        return {r["item"]: r["rank"] for r in scoring.rank(found, ["user"], "rank_score", "rank").collect()}[11]

    assert place(1.0) == 1 < place(0.0)


def test_legacy_is_a_weighted_mean(spark, world):
    _, edges, stats = world
    values = {0: 1.0, 1: 0.5, 6: -1.0}
    got = scoring.score(_rated(spark, values.items()), edges, stats, replace(SCORE, use_residual_input=False)).where("item = 3").first()
    sims = {r.i: r.sim for r in edges.where("j = 3 AND i IN (0, 1, 6)").collect()}
    assert got.pred_z == pytest.approx(sum(sims[i] * values[i] for i in sims) / sum(map(abs, sims.values())))
    assert got.pred_d is None and got.n_neighbours == len(sims)


def test_support_floor_refuses(spark, world):
    _, edges, stats = world
    found = scoring.score(_rated(spark, [(0, 1.0)]), edges, stats, replace(SCORE, min_support=1e9))
    assert found.where("scoreable OR rank_score IS NOT NULL").count() == 0


def test_prediction_shrinkage_keeps_the_sign(spark, world):
    _, edges, stats = world
    rated = _rated(spark, [(0, 2.0), (1, 2.0)])
    plain, shrunk = ({r["item"]: r.pred_d for r in scoring.score(rated, edges, stats, replace(SCORE, pred_shrinkage_k=k)).collect()} for k in (0.0, 3.0))
    assert all(abs(shrunk[i]) <= abs(plain[i]) and shrunk[i] * plain[i] >= 0 for i in plain)


def test_explanation_adds_up(spark, world):
    _, edges, stats = world
    rated = _rated(spark, [(0, 1.0), (1, -0.5), (2, 0.7), (6, 0.2), (7, 1.4)])
    wanted = spark.createDataFrame([(1, 4)], "user long, item long")
    why = scoring.explain(rated, edges, stats, wanted, 100, SCORE).collect()
    got = scoring.score(rated, edges, stats, SCORE).where("item = 4").first()
    assert len(why) == got.n_neighbours
    assert sum(r.contribution for r in why) == pytest.approx(got.pred_d * got.support)


def test_two_passes_aren_t_a_fixed_point(spark):
    rows = [(u, i, 3.0) for u in range(6) for i in range(4) if not (u == 5 and i > 1)]
    fact = spark.createDataFrame(rows, "user long, item long, rating double")
    kept = ratings.two_pass_filter(fact, StagingConfig(min_item_ratings=5, min_user_ratings=3))
    assert kept.select("user").distinct().count() == 5 and kept.count() == 20


def test_dense_index_follows_id_order(spark):
    ids = spark.createDataFrame([(x,) for x in (50, 7, 7, 900, -3)], "id long")
    assert {r.id: r.at for r in ratings.dense_index(ids, "id", "at").collect()} == {-3: 0, 7: 1, 50: 2, 900: 3}


def test_profile_rules(spark):
    rows = [("A", 2000, 1.0, "2018-01-01", 0), ("A", 2000, 5.0, "2024-01-01", 1), ("B", None, 4.0, "2021-01-01", 2), ("C", 1999, 3.0, None, 3), ("D", 1990, None, "2024-01-01", 4)]
    df = spark.createDataFrame([(1, *r) for r in rows], "user long, title string, year int, rating double, logged_date string, ord long").withColumn("logged_date", F.to_date("logged_date"))
    likes = spark.createDataFrame([(1, "B", None)], "user long, title string, year int")
    films, stats = profile.profile(df, likes)
    got, s = {r.title: r for r in films.collect()}, stats.first()
    assert set(got) == {"A", "B", "C"} and got["A"].rating == 5.0
    assert s["mean"] == pytest.approx(4.0) and s.sigma == pytest.approx((2 / 3) ** 0.5)
    assert got["A"].weight == pytest.approx(1.0) and got["B"].weight == pytest.approx(0.5, abs=1e-3)
    assert got["B"].is_liked and not got["A"].is_liked


def test_diversify_keeps_one_of_a_work_and_few_of_a_series(spark):
    titles = ["Saga: One", "Saga: Two", "Saga: Three", "Tale Part I", "Tale Part II", "Other", "Seen Part II"]
    df = spark.createDataFrame([(1, i, t, 2000 + i, i + 1) for i, t in enumerate(titles)], "user long, item long, clean_title string, year int, rank int")
    seen = presentation.seen_works(spark.createDataFrame([(1, "Seen Part I")], "user long, clean_title string"))
    got = presentation.diversify(df, 10, PresentationConfig(), seen).orderBy("rank")
    assert [r["item"] for r in got.collect()] == [0, 1, 3, 5]
    off = presentation.diversify(df, 3, PresentationConfig(dedupe_same_work=False, max_per_series=0), seen)
    assert sorted(r["item"] for r in off.collect()) == [0, 1, 2]


def test_splits_and_ranking_metrics(world):
    fact, edges, stats = world
    config = EvalConfig(holdout_min=1, holdout_max=100, ks=(3,), repeats=2)
    users = evaluation.eval_users(fact, config, 5)
    halves = evaluation.splits(ratings.z_scores(fact).join(users, "user", "left_semi"), config)
    sizes = halves.groupBy("user", "split").agg(F.sum(F.col("test").cast("int")).alias("n")).collect()
    assert len(sizes) == 10 and all(r.n == 3 for r in sizes)  # 13 / 5 rounds half to even
    rows = evaluation.held_out(halves, edges, stats, SCORE, None, config)
    metrics = evaluation.ranking_metrics(evaluation.observations(rows, stats), rows, config).collect()
    assert len(metrics) == 40 and all(0 <= m.recall_3 <= 1 and 0 <= m.ndcg_3 <= 1 + 1e-9 for m in metrics)
    with pytest.raises(ValueError):
        evaluation.eval_users(fact, config, 1000)
    with pytest.raises(ValueError):
        ratings.assert_disjoint(fact, users)
    ratings.assert_disjoint(ratings.without_users(fact, users), users)


def test_draws_by_share(world):
    config = EvalConfig(holdout_min=1, holdout_max=100, holdout_share=0.1)
    assert evaluation.eval_users(world[0], config).count() == 8 and evaluation.eval_users(world[0], replace(config, holdout_users=5)).count() == 5


def test_sweep_agrees_with_single_configurations(world):
    fact, edges, stats = world
    config = EvalConfig(holdout_min=1, holdout_max=100, repeats=2)
    rated, scale = evaluation.as_profiles(ratings.z_scores(fact), evaluation.eval_users(fact, config, 4))
    configs = {"floor": replace(SCORE, min_support=0.4), "plain": replace(SCORE, use_residual_input=False)}
    table = {r.config: r for r in recommend.sweep(rated, edges, stats, configs, config).collect()}
    for name, c in configs.items():
        seen = evaluation.observations(evaluation.held_out(evaluation.splits(rated, config), edges, stats, c, None, config), stats)
        rows = {r["row"]: r for r in evaluation.pooled_table(seen).collect()}
        one = rows[evaluation.METHODS_FIRST]
        assert (table[name].n, table[name].ALL, table[name].rankable) == (rows["n"].ALL, one.ALL, rows["rankable"].ALL)
        low = [x for x in (one.Q1, one.Q2, one.Q3) if x is not None]
        assert table[name].Q1_3 == (pytest.approx(sum(low) / len(low)) if low else None)
    seen, errors = evaluation.evaluate_users(ratings.z_scores(fact), rated.select("user").distinct(), edges, stats, SCORE, config)
    pooled = evaluation.pooled_error(errors).first()
    by_user = {}
    for r in errors.collect():
        by_user.setdefault(r.user, []).append(r.mae)
    assert pooled.users == 4 and pooled.mae == pytest.approx(sum(sum(x) / len(x) for x in by_user.values()) / 4) and seen.count() > 0 and scale.count() == 4


def test_heavy_users_are_dealt_into_blocks(world, monkeypatch):
    want = {(r.i, r.j): (r.sim, r.n_co) for r in similarity.pairs(similarity.vectors(world[0], SIM), SIM).collect()}
    monkeypatch.setattr(similarity, "BLOCK", 4)
    got = {(r.i, r.j): (r.sim, r.n_co) for r in similarity.pairs(similarity.vectors(world[0], SIM), SIM).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)


def test_dense_index_over_many_ranges(spark):
    ids = [x * 37 % 10_007 for x in range(3_000)]
    df = spark.createDataFrame([(x,) for x in [*ids, *ids[:50], None]], "id long").repartition(7)
    assert {r.id: r.at for r in ratings.dense_index(df, "id", "at").collect()} == {x: i for i, x in enumerate(sorted(ids))}
    assert ratings.dense_index(df.limit(0), "id", "at").count() == 0
    assert {r.id: r.at for r in ratings.dense_index(spark.createDataFrame([("b",), ("a",), ("b",)], "id string"), "id", "at").collect()} == {"a": 0, "b": 1}


def test_neighbours_of_one_item(spark, world):
    items = spark.createDataFrame([(i, f"Film {i}", "movie" if i % 2 else "tvSeries") for i in range(13)], "item long, clean_title string, title_type string")
    near = similarity.neighbours(world[1], items, 0, 4).collect()
    assert len(near) == 4 and [r.sim for r in near] == sorted((r.sim for r in near), reverse=True) and {r.j for r in near} <= set(range(1, 6)) | {12}
    stats = world[2].withColumn("n_ratings", F.when(F.col("item") == 12, 1).otherwise(F.col("n_ratings")))
    found = recommend.neighbours_by_title(world[1], stats, items, "FILM 1", 5).collect()  # 1, 10, 11 and 12 hold the text; of equally rated ones the least item
    assert {r["item"] % 2 for r in found} == {1} and [r.place for r in found] == sorted(r.place for r in found) and found[-1].place <= 5
    assert recommend.neighbours_by_title(world[1], stats, items, "no such film").count() == 0


def test_artefacts_are_built_without_the_held_out(spark, world, tmp_path):
    from tastegraph.sources import staging

    config = EvalConfig(holdout_min=1, holdout_max=100, holdout_users=10)
    edges, stats, users = recommend.build_artefacts(spark, world[0], str(tmp_path), StagingConfig(5, 3), SIM, config)
    assert users.count() == 10 and staging.load_holdout(spark, str(tmp_path)).count() == 10
    rest = similarity.build(ratings.without_users(world[0], users), SIM)
    assert edges.agg(F.max("n_co")).first()[0] == 70 == rest.agg(F.max("n_co")).first()[0] and stats.count() == 13
    stats.drop("z_mean").write.parquet(f"{tmp_path}/old/stats")
    edges.write.parquet(f"{tmp_path}/old/edges")
    _, old, warnings = staging.load_similarity(spark, f"{tmp_path}/old")
    assert {r.z_mean for r in old.collect()} == {0.0} and len(warnings) == 1


def test_settings_from_the_session(spark):
    from tastegraph.config import MatchConfig, from_session

    given = {"ScoringConfig.popularity_alpha": "0.4", "ScoringConfig.use_residual_input": "false", "EvalConfig.ks": "5, 7", "PresentationConfig.min_predicted_z": "none"}
    try:
        for k, v in given.items():
            spark.conf.set(f"tastegraph.{k}", v)
        assert from_session(spark, ScoringConfig()) == ScoringConfig(popularity_alpha=0.4, use_residual_input=False)
        assert from_session(spark, EvalConfig()).ks == (5, 7) and from_session(spark, PresentationConfig()).min_predicted_z is None and from_session(spark, MatchConfig()) == MatchConfig()
    finally:
        for k in given:
            spark.conf.unset(f"tastegraph.{k}")


def test_rankable_table_is_empty_when_nothing_is(world):
    fact, edges, stats = world
    config = EvalConfig(holdout_min=1, holdout_max=100, repeats=1)
    users = evaluation.eval_users(fact, config, 3)
    rows = evaluation.held_out(evaluation.splits(ratings.z_scores(fact).join(users, "user", "left_semi"), config), edges, stats, replace(SCORE, min_support=1e9), None, config)
    seen = evaluation.observations(rows, stats)
    assert evaluation.pooled_table(seen, scoreable_only=True).count() == 0
    assert {r["row"]: r.ALL for r in evaluation.pooled_table(seen).collect()}["rankable"] == 0.0
