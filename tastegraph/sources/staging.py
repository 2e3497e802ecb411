"""Ratings corpus in, staged tables out: CSV scans, the item dimension, Parquet artefacts that are built once and read again."""

from __future__ import annotations

import gc
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import StagingConfig
from ..functions.titles import split_year
from ..operators.ratings import index_ratings, item_stats, two_pass_filter

RATINGS_SCHEMA = "userId INT, movieId INT, rating FLOAT, timestamp LONG"


def scan_ratings(spark: SparkSession, path: str) -> DataFrame:
    """user, item, rating of a ratings CSV; the other column isn't parsed."""
    rows = spark.read.csv(path, header=True, schema=RATINGS_SCHEMA)
    return rows.select(F.col("userId").alias("user"), F.col("movieId").alias("item"), F.col("rating").cast("double").alias("rating"))


def scan_items(spark: SparkSession, movies: str, links: str) -> DataFrame:
    """item, clean_title, title, year, genres, imdbId, tmdbId: years split from titles, ids as text."""
    m = spark.read.csv(movies, header=True, schema="movieId INT, title STRING, genres STRING", quote='"', escape='"')
    known = spark.read.csv(links, header=True, schema="movieId INT, imdbId STRING, tmdbId STRING")
    title, year = split_year(F.col("title"))
    return m.join(known, "movieId", "left").select(F.col("movieId").alias("item"), title.alias("clean_title"), "title", year.alias("year"), "genres", "imdbId", "tmdbId")


def scan_title_types(spark: SparkSession, path: str) -> DataFrame:
    """catalogue_id, title_type of a (gzipped) tab-separated title dump: two columns of many, ``\\N`` as null, ids without their prefix."""
    rows = spark.read.csv(path, header=True, sep="\t", nullValue="\\N", quote="", inferSchema=False)
    return rows.select(F.regexp_replace("tconst", "^tt", "").alias("catalogue_id"), F.col("titleType").alias("title_type")).dropna()


def _checkpoints(df: DataFrame) -> str:
    """The folder in spark.checkpoint.dir; it is set here only if the session has none (tests)."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir, its plan cut there."""
    _checkpoints(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, as Parquet: for large tables, a fraction of a checkpoint's size. Spark drops the shuffle files of finished steps when the driver collects its
    garbage, so it is asked to."""
    path = f"{_checkpoints(df)}/{uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def once(spark: SparkSession, path: str, make, force: bool = False) -> DataFrame:
    """The Parquet table at path, made and written first if it isn't there whole (or ``force``). A table that is there but can't be read is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not force and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
        return spark.read.parquet(path)
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stage(spark: SparkSession, folder: str, out: str, config: StagingConfig = StagingConfig(), force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ratings: user_idx, item_idx, rating; items: item_idx, item, titles, ids, n_ratings, mean_rating), staged under ``out``.

    Items in the ratings but not in the catalogue keep an empty title."""

    def fact() -> DataFrame:
        return two_pass_filter(scan_ratings(spark, f"{folder}/ratings.csv"), config)

    kept = once(spark, f"{out}/filtered", fact, force)
    indexed, _, item_map = index_ratings(kept)
    ratings = once(spark, f"{out}/ratings", lambda: indexed, force)

    def dimension() -> DataFrame:
        meta = scan_items(spark, f"{folder}/movies.csv", f"{folder}/links.csv")
        stats = item_stats(kept)
        rows = item_map.join(meta, "item", "left").join(stats, "item", "left")
        return rows.withColumns({"clean_title": F.coalesce("clean_title", F.lit("")), "n_ratings": F.coalesce("n_ratings", F.lit(0))})

    return ratings, once(spark, f"{out}/items", dimension, force)


def save_similarity(edges: DataFrame, stats: DataFrame, out: str) -> None:
    """Edges sorted within files by i (scans for one item skip row groups), and item statistics."""
    edges.repartition("i").sortWithinPartitions("i", "j").write.mode("overwrite").parquet(f"{out}/edges")
    stats.write.mode("overwrite").parquet(f"{out}/stats")


def load_similarity(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(edges, stats, warnings); artefacts without a consensus column get zeros."""
    edges, stats, warnings = spark.read.parquet(f"{out}/edges"), spark.read.parquet(f"{out}/stats"), []
    if "z_mean" not in stats.columns:
        stats = stats.withColumn("z_mean", F.lit(0.0))
        warnings.append("no consensus in these artefacts: scores fall back to neighbours only; build them again")
    return edges, stats.withColumn("z_mean", F.coalesce("z_mean", F.lit(0.0))), warnings


def title_types(spark: SparkSession, path: str, out: str, force: bool = False) -> DataFrame:
    """The reduction of a title dump to its two columns, written once and read again."""
    return once(spark, f"{out}/title_types", lambda: scan_title_types(spark, path), force)


def save_holdout(users: DataFrame, out: str) -> None:
    """The users that the similarity must not be built on."""
    users.select("user").write.mode("overwrite").parquet(f"{out}/holdout_users")


def load_holdout(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/holdout_users")


def save_items(items: DataFrame, out: str) -> None:
    """The item dimension as one folder of CSV files with headers, for other tools; Parquet is what the engine reads."""
    items.write.mode("overwrite").csv(f"{out}/items_csv", header=True)


def save_report(matched: DataFrame, out: str) -> None:
    """Matches and misses as CSV files with headers."""
    matched.where("item IS NOT NULL").write.mode("overwrite").csv(f"{out}/matched", header=True)
    matched.where("item IS NULL").write.mode("overwrite").csv(f"{out}/unmatched", header=True)


