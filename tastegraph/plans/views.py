"""The driver's tables read as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def half_stars(x: Column) -> Column:
    return F.greatest(F.lit(0.5), F.round(x) / 2)


def ratings_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, rating from events: every user meets most of a hundred items.

    Values are summed in the order of events: a mean at the edge between two ratings falls on one side or the other by the order in which doubles are added,
    and the order in which a shuffle delivers partial sums changes with files and partitions."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("long").alias("item"), "event_id", "value")
    values = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("event_id", "value"))))
    mean = F.try_divide(F.aggregate("_v", F.lit(0.0), lambda total, x: total + x["value"]), F.size("_v"))
    return e.groupBy("user", "item").agg(values.alias("_v")).select("user", "item", F.least(F.lit(5.0), half_stars(mean / 10)).alias("rating"))


def ratings_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, rating from lineitem and orders: a large catalogue with few common raters."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    return lines.join(orders, "l_orderkey").groupBy("user", "item").agg(half_stars(F.avg("l_quantity") / 5).alias("rating"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, clean_title, year (null for every 11th), title_type, catalogue_id from part."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    year = F.when(key % 11 != 0, (F.col("p_size") + 1950).cast("int"))
    return p.select(key.alias("item"), F.col("p_name").alias("clean_title"), year.alias("year"), F.col("p_type").alias("title_type"), key.cast("string").alias("catalogue_id"))


def dense_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, clean_title, year, title_type for the items of ratings_dense: titles with parts, series and alternates made from the names in part."""
    p = table(spark, sf_dir, "part")
    n, name = F.col("p_partkey"), F.initcap("p_name")
    part = F.element_at(F.array(*[F.lit(x) for x in ("I", "II", "III", "IV")]), (n % 4 + 1).cast("int"))
    title = (
        F.when(n % 5 == 0, F.concat(name, F.lit(" Part "), part))
        .when(n % 5 == 1, F.concat(name, F.lit(", The")))
        .when(n % 5 == 2, F.concat(F.lit("Saga of "), name, F.lit(": Chapter")))
        .when(n % 5 == 3, F.concat(name, F.lit(" (a.k.a. The "), name, F.lit(")")))
        .otherwise(name)
    )
    return p.select(n.alias("item"), title.alias("clean_title"), (F.col("p_size") + 1950).cast("int").alias("year"), F.col("p_type").alias("title_type"))


def films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film_id, title, year, rating, logged_date, ord: an export's ratings made from part, with rotated articles, dropped letters and shifted or missing years."""
    p = table(spark, sf_dir, "part")
    n, name = F.col("p_partkey"), F.col("p_name")
    title = (
        F.when(n % 5 == 0, name)
        .when(n % 5 == 1, F.concat(name, F.lit(", The")))
        .when(n % 5 == 2, F.concat(F.substring(name, 1, 2), F.substring(name, 4, 100)))
        .when(n % 5 == 3, F.concat(F.lit("The "), F.upper(name)))
        .otherwise(F.concat_ws(" ", F.element_at(F.split(name, " "), 2), F.element_at(F.split(name, " "), 1)))
    )
    year = F.when(n % 7 == 0, F.lit(None).cast("int")).when(n % 7 == 1, F.col("p_size") + 1951).when(n % 7 == 2, F.col("p_size") + 1956).otherwise(F.col("p_size") + 1950)
    day = F.date_sub(F.lit("2024-01-01").cast("date"), (n % 900).cast("int"))
    return p.select(n.alias("film_id"), title.alias("title"), year.cast("int").alias("year"), (F.lit(0.5) + (n % 10) / 2).alias("rating"), F.when(n % 13 != 0, day).alias("logged_date"), n.alias("ord"))
