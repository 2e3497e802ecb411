"""What larger tables showed: shared titles, sums in any order, plans that read their input once."""

import random

import pytest
from pyspark.sql import functions as F

from tastegraph.config import SimilarityConfig
from tastegraph.operators import matching, profile, scoring, similarity
from tastegraph.plans import queries as core
from tastegraph.plans import views


def test_a_title_that_many_items_share_is_one_row_of_the_index(spark):
    catalogue = spark.range(500).select(F.col("id").alias("item"), F.lit("Blue Ring").alias("clean_title"), F.when(F.col("id") > 0, 1990 + F.col("id") % 2).cast("int").alias("year"))
    index = matching.title_index(catalogue)
    assert {(r.key, r.item_year, r["item"], r.entries) for r in index.collect()} == {("blue ring", None, 0, 500), ("blue ring", 1990, 2, 500), ("blue ring", 1991, 1, 500)} and index.count() == 3
    films = spark.createDataFrame([(1, "blue ring", 1990), (2, "Blue Ring", 1990), (3, "blue ring", 1990), (4, "blue ring", 1992), (5, "blue ring", None), (6, None, 1990)], "film_id long, title string, year int")
    assert {(r.film_id, r["item"], r.item_year, r.method) for r in matching.match_exact(films, index).collect()} == {(k, 2, 1990, matching.EXACT) for k in (1, 2, 3)} | {(4, 1, 1991, matching.NEAR)}


def test_what_titles_match_is_found_once_for_each_title_and_year(spark):
    catalogue = spark.createDataFrame([(1, "Blue Ring", 1990), (2, "Blue Ring", 1990), (3, "Old Anvil", None)], "item long, clean_title string, year int")
    asked = [("Blue Ring", 1990), ("Blue Rings", 1990), ("Old Anvil", None), ("Nothing", 1990), (None, 1990), ("Blue Ring", None)]
    films = spark.createDataFrame([(k, *asked[k % 6], 0.5 + k % 10 / 2) for k in range(60)], "film_id long, title string, year int, rating double")
    found = {(r.title, r.year): (r["item"], r.item_year, r.method) for r in matching.found_titles(films, catalogue).collect()}
    assert found == {("Blue Ring", 1990): (1, 1990, matching.EXACT), ("Blue Rings", 1990): (1, 1990, "fuzzy sort 95"), ("Old Anvil", None): (3, None, matching.UNDATED_FILM)}
    rows = matching.match(films, catalogue).collect()
    none = (None, None, None)
    assert len(rows) == 60 and all((r["item"], r.method) == found.get((r.title, r.year), none)[::2] and r.item_year == (-9999 if r["item"] == 3 else found.get((r.title, r.year), none)[1]) for r in rows)


@pytest.mark.parametrize("name", ["match_report", "profile_line", "watchlist_match"])
def test_how_films_are_matched_needs_no_ratings(spark, sf, name):
    assert not [x for x in core.queries()[name](spark, sf).inputFiles() if "lineitem" in x or "orders" in x]


def test_ratings_of_other_items_leave_before_they_are_joined(spark, sf):
    plan = core.queries()["match_films"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda text: [k for k, x in enumerate(plan) if text in x]
    assert len(at("LeftSemi")) == 1 and at("Join Inner")[0] < at("LeftSemi")[0] < at("l_orderkey")[-1]


def test_a_mean_between_two_ratings_is_summed_in_event_order(spark, tmp_path):
    """7.94 + 36.4 + 0.66 is just under 45 in this order, and 45 in others."""
    values = [(0, 7.94), (1, 36.4), (2, 0.66), (3, None)]
    for k, order in enumerate(([0, 1, 2, 3], [2, 3, 1, 0], [0, 2, 3, 1])):
        rows = [(values[x][0], 1, '{"k": 5}', values[x][1]) for x in order] + [(9, 2, '{"k": 5}', None)]
        spark.createDataFrame(rows, "event_id long, user_id long, props string, value double").coalesce(1).write.parquet(f"{tmp_path}/{k}/events.parquet")
        assert {(r.user, r["item"], r.rating) for r in views.ratings_dense(spark, f"{tmp_path}/{k}").collect()} == {(1, 5, 0.5), (2, 5, 0.5)}


def test_a_rounded_zero_keeps_its_sign(spark):
    given = [-0.0000001, 0.0000001, -0.0, 0.0, -0.0000006, 1.25, None, float("nan"), float("-inf")]
    df = spark.createDataFrame([(k, v, k) for k, v in enumerate(given)], "k int, v double, n long")
    found = [str(r.v) for r in core.rounded(df, "v", "n").orderBy("k").collect()]
    assert found == ["-0.0", "0.0", "-0.0", "0.0", "-1e-06", "1.25", "None", "nan", "-inf"] and core.rounded(df, "v", "n").dtypes == df.dtypes


def test_a_spread_of_just_the_floor_is_not_below_it(spark):
    """Eight ratings with a deviation of exactly one half, in 200 orders."""
    given, shuffled = [1.0, 1.5, 2.0, 2.0, 1.0, 0.5, 1.0, 1.0], random.Random(5)
    rows = [(u, f"T{k}", 2000, r, None, k) for u in range(200) for k, r in enumerate(shuffled.sample(given, 8))]
    df = spark.createDataFrame(rows, "user long, title string, year int, rating double, logged_date date, ord long")
    _, stats = profile.profile(df)
    assert {(r.sigma_raw, len(r.warnings)) for r in stats.select("sigma_raw", "warnings").collect()} == {(0.5, 1)}  # no dates: the one warning


def test_dense_index_reads_its_tables_once(spark, sf):
    plan = core.queries()["dense_index"](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "parquet" not in plan.lower()


def test_passes_over_items_give_the_same_neighbours(spark, monkeypatch):
    rows = [(u, i, 0.5 + (u * 7 + i * i * 3) % 10 / 2) for u in range(40) for i in range(30) if (u * 31 + i * 17) % 5 < 2 or u == 0]
    fact, config = spark.createDataFrame(rows, "user long, item long, rating double"), SimilarityConfig(shrinkage_lambda=2.0, top_k_neighbours=7)
    found = lambda: {(r.i, r.j): (round(r.sim, 9), r.n_co) for r in similarity.build(fact, config).collect()}
    want = found()
    monkeypatch.setattr(similarity, "PASS", 200)
    monkeypatch.setattr(similarity, "BLOCK", 20)  # user 0 has two blocks, the others one
    assert similarity._passes(fact) == 5 and found() == want


def test_evidence_is_summed_where_the_ratings_are(spark, tmp_path):
    """Ratings x edges rows aren't shuffled when the edges are a small table; without the grid, rated items leave without a join."""
    rows = [(u, i, ((u * 7 + i * 3) % 11 - 5) / 3) for u in range(30) for i in range(20) if (u + i * i) % 3]
    pairs = [(i, j, ((i * 5 + j * 3) % 9 - 4) / 10) for i in range(20) for j in range(20) if i != j and (i + j) % 4]
    tables = {"rated": (rows, "user long, item long, z double"), "edges": (pairs, "i long, j long, sim double"), "stats": ([(i, 9, 3.0, i / 50) for i in range(20)], "item long, n_ratings int, mean_rating double, z_mean double")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}")
    rated, edges, stats = (spark.read.parquet(f"{tmp_path}/{name}") for name in tables)
    found = scoring.evidence(scoring.input_values(rated, stats), edges)
    dealt = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
    assert len(dealt) == 1 and "item" not in dealt[0].split("hashpartitioning")[1].split(")")[0]
    got = {(r.user, r["item"]): (round(r.support, 9), r.n_neighbours) for r in scoring.score(rated, edges, stats, every=False).collect()}
    mine, want = {(u, i) for u, i, _ in rows}, {}
    for u, i, _ in rows:
        for a, j, sim in pairs:
            if a == i and (u, j) not in mine:
                den, n = want.get((u, j), (0.0, 0))
                want[u, j] = den + abs(sim), n + 1
    assert got == {k: (round(den, 9), n) for k, (den, n) in want.items()}
