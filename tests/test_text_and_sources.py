import zipfile

import pytest
from pyspark.sql import functions as F

from tastegraph.config import MatchConfig
from tastegraph.functions import fuzzy, titles
from tastegraph.operators import matching
from tastegraph.sources import export, staging
from tastegraph.streaming import item_stats


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_norm_title(spark):
    got = values(spark, titles.norm_title, ["Matrix, The", "Amélie", "Amélie", "Fast & Furious", "WALL·E", "Cidade de Deus", None, ""])
    assert got == ["the matrix", "amelie", "amelie", "fast and furious", "wall e", "cidade de deus", "", ""]


def test_work_keys(spark):
    f = lambda c: titles.work_key(c, F.lit(1995))
    got = values(spark, f, ["Human Condition II, The", "Human Condition I, The", "Godfather: Part II, The", "Seven", "Voyna i mir III. - Borogyino", "X"])
    assert got[0] == got[1] == "work::the human condition" and got[2] == "work::the godfather"
    assert got[3] == "title::seven::1995" and got[4] == "work::voyna i mir" and got[5].startswith("title::")


def test_series_display_bases_ids(spark):
    assert values(spark, titles.series_key, ["Star Wars: Episode IV", "Up: X", "Plain"]) == ["star wars", None, None]
    assert values(spark, titles.display_title, ["Avventura, L' (a.k.a. Adventure, The)", "(500)"]) == ["L'Avventura", "(500)"]
    assert values(spark, titles.catalogue_id, ["133093", "0133093.0", "10872600", None]) == ["0133093", "0133093", "10872600", None]


def test_nfkd_goes_beyond_latin(spark):
    assert values(spark, titles.nfkd, ["Amélie", "ﬁn", "Й", None]) == ["Amelie", "fin", "И", None]


def test_ratios(spark):
    rows = spark.createDataFrame([("arthous 0", "arthouse 0"), ("0 arthouse", "arthouse 0"), ("a", "b")], "a string, b string")
    got = [round(r.x, 1) for r in rows.select(fuzzy.token_sort_ratio(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [94.7, 100.0, 0.0]


def test_both_forms_of_the_ratio_agree(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(0, 30)))
    pairs = [(word(), word()) for _ in range(300)] + [("x" * 200, "xy" * 150), ("", ""), ("a", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(fuzzy.ratio(F.col("a"), F.col("b")).alias("x"), fuzzy.native_ratio(F.col("a"), F.col("b")).alias("y")).collect()
    assert all(r.x == pytest.approx(r.y) for r in rows)
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(fuzzy.token_set_ratio(F.col("a"), F.col("b")).alias("x"), fuzzy.token_sort_ratio(F.col("a"), F.col("b")).alias("y")).first() == (None, None)


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [(i, f"Arthouse {i}", 1990 + i) for i in range(6)] + [(12, "Universally Adored", 2002), (20, "Ambulance", 2005), (21, "Ambulance", 2022), (30, "Lone One", None)]
    return spark.createDataFrame(rows, "item long, clean_title string, year int")


def found(spark, catalogue, title, year, config=MatchConfig()):
    film = spark.createDataFrame([(1, title, year)], "film_id long, title string, year int")
    r = matching.match(film, catalogue, config).first()
    return r["item"], r["method"]


def test_match_rules(spark, catalogue):
    assert found(spark, catalogue, "Arthouse 0", 1990) == (0, "exact title+year")
    assert found(spark, catalogue, "Arthouse 0", 1991)[1].endswith("+/-1")
    assert found(spark, catalogue, "Universally Adored", 2008)[0] is None
    assert "MISMATCH" in found(spark, catalogue, "Universally Adored", 2008, MatchConfig(require_year_agreement=False))[1]
    assert found(spark, catalogue, "Universally Adored", None) == (12, "exact title, no year given")
    assert found(spark, catalogue, "Ambulance", 2022)[0] == 21
    assert found(spark, catalogue, "Ambulance", None)[0] is None
    assert found(spark, catalogue, "Lone One", 1999)[0] == 30
    assert found(spark, catalogue, "Arthous 0", 1990)[0] == 0
    assert found(spark, catalogue, "Arthous 0", 1990, MatchConfig(fuzzy_threshold=99.0))[0] is None


RATINGS = "Date,Name,Year,Some URI,Rating\n2024-01-01,A,2000,http://x/a,4.5\n2024-01-02,\"B, the \"\"b\"\"\",,http://x/b,\nbad,C,20x0,http://x/c,3\n"
WATCHED = "Date,Name,Year,Some URI\n2024-01-01,A,2000,http://x/a\n2024-01-01,W,1999,http://x/w\n"


def test_export_folder_and_zip(spark, tmp_path):
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat/ratings.csv").write_text(RATINGS)
    (tmp_path / "flat/watched.csv").write_text(WATCHED)
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("deleted/ratings.csv", RATINGS.replace(",4.5", ",1"))
        z.writestr("wrap/ratings.csv", RATINGS)
        z.writestr("wrap/watched.csv", WATCHED)
    for path in (tmp_path / "flat", tmp_path / "e.zip"):
        got = export.load_export(spark, str(path), str(tmp_path))
        rows = {r.title: r for r in got.ratings.collect()}
        assert set(rows) == {"A", "C"} and rows["A"].rating == 4.5 and rows["C"].year is None and rows["C"].logged_date is None
        assert {r.title for r in got.watched_titles().collect()} >= {"A", "W"}
        assert "diary.csv" in got.missing and got.summary()["rated"] == 2


def test_export_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        export.load_export(spark, str(tmp_path / "none"))
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(ValueError):
        export.load_export(spark, str(tmp_path / "x.txt"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        export.load_export(spark, str(tmp_path / "empty"))


def test_staging_is_done_once(spark, tmp_path):
    ratings = "userId,movieId,rating,timestamp\n" + "".join(f"{u},{m},{(u + m) % 9 / 2 + 0.5},0\n" for u in range(1, 31) for m in (5, 9, 70))
    (tmp_path / "ratings.csv").write_text(ratings)
    (tmp_path / "movies.csv").write_text('movieId,title,genres\n5,"Matrix, The (1999)",A|B\n9,His Last Vow (),C\n70,Up (2009),D\n')
    (tmp_path / "links.csv").write_text("movieId,imdbId,tmdbId\n5,0133093,603\n")
    config = staging.StagingConfig(min_item_ratings=20, min_user_ratings=3)
    rows, items = staging.stage(spark, str(tmp_path), str(tmp_path / "out"), config)
    assert rows.count() == 90 and rows.agg(F.max("item_idx")).first()[0] == 2
    got = {r["item"]: r for r in items.collect()}
    assert (got[5].clean_title, got[5].year, got[5].imdbId, got[9].year, got[9].clean_title) == ("Matrix, The", 1999, "0133093", None, "His Last Vow ()")
    (tmp_path / "ratings.csv").unlink()
    assert staging.stage(spark, str(tmp_path), str(tmp_path / "out"), config)[0].count() == 90


def test_artefacts_that_are_there_but_broken(spark, tmp_path):
    """... are an error, not a reason to build over them; one without its mark of completion is built again."""
    made = lambda: spark.range(3)
    assert staging.once(spark, f"{tmp_path}/t", made).count() == 3 and staging.once(spark, f"{tmp_path}/t", lambda: spark.range(9)).count() == 3
    (tmp_path / "half").mkdir()
    assert staging.once(spark, f"{tmp_path}/half", made).count() == 3
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/_SUCCESS").write_text("")
    with pytest.raises(Exception):
        staging.once(spark, f"{tmp_path}/bad", made)


def test_profile_report(spark, tmp_path, catalogue):
    from tastegraph.operators import ratings
    from tastegraph.plans import recommend

    (tmp_path / "e").mkdir()
    (tmp_path / "e/ratings.csv").write_text("Date,Name,Year,Some URI,Rating\n2024-01-01,Arthouse 0,1990,x,5\n2024-01-02,Arthouse 1,1991,x,2\n2024-01-03,Nowhere,2024,x,4\n")
    (tmp_path / "e/watchlist.csv").write_text("Date,Name,Year,Some URI\n2024-01-01,Ambulance,2022,x\n2024-01-01,Never Made,1999,x\n")
    stats = ratings.item_stats(spark.createDataFrame([(1, 0, 4.0), (2, 0, 3.0)], "user long, item long, rating double"))
    got = recommend.profile_report(export.load_export(spark, str(tmp_path / "e")), catalogue, stats, out=str(tmp_path / "out"))
    assert {(r["table"], r.method): r.n for r in got["methods"].collect()} == {("rated", "exact title+year"): 2, ("rated", "unmatched"): 1, ("watchlist", "exact title+year"): 1, ("watchlist", "unmatched"): 1}
    assert got["coverage"].first().n == 1 and got["summary"].first().n == 3
    assert {r.title: r.residual for r in got["matched"].collect()} == {"Arthouse 0": 1.5, "Arthouse 1": None, "Nowhere": None}
    assert spark.read.csv(f"{tmp_path}/out/matched", header=True).count() == 2 and spark.read.csv(f"{tmp_path}/out/unmatched", header=True).first().title == "Nowhere"


def test_title_types(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('tconst\ttitleType\tx\ntt01\tmovie\t"a\ntt02\t\\N\tb\n')
    assert [tuple(r) for r in staging.scan_title_types(spark, str(tmp_path / "t.tsv")).collect()] == [("01", "movie")]
    assert staging.title_types(spark, str(tmp_path / "t.tsv"), str(tmp_path / "types")).count() == 1
    (tmp_path / "t.tsv").unlink()
    assert staging.title_types(spark, str(tmp_path / "t.tsv"), str(tmp_path / "types")).count() == 1


def test_stream_equals_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    key = lambda df: sorted((r["item"], r.n_events, round(r.mean_value, 6), r.last_ts) for r in df.collect())
    assert key(item_stats.drained(spark, sf)) == key(item_stats.item_stats(events))
    assert item_stats.windowed_activity(events).agg(F.sum("n_events")).first()[0] == events.count()
