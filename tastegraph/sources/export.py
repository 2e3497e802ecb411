"""A member's account export: a folder or a ZIP of CSV files with drifting headers.

Only the ratings file is required. Files that are missing or can't be parsed become empty tables and are listed in ``missing``.
Copies under ``deleted/`` and ``orphaned/`` are never read, in folders and archives alike.
"""

from __future__ import annotations

import posixpath
import zipfile
from dataclasses import dataclass, field
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import EXPORT_FILES, HEADERS
from ..functions.titles import strip
from ..operators.profile import seen_titles

HIDDEN = ("deleted", "orphaned")
_URI = " uri"
_EMPTY = T.StructType([T.StructField("logged_date", T.TimestampType()), T.StructField("title", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("lb_uri", T.StringType()), T.StructField("ord", T.LongType())])


@dataclass(frozen=True)
class Export:
    """The six tables, each with ``ord`` (row order in its file), where they came from, and what was missing."""

    ratings: DataFrame
    diary: DataFrame
    reviews: DataFrame
    watchlist: DataFrame
    watched: DataFrame
    likes: DataFrame
    source: str = ""
    missing: list[str] = field(default_factory=list)

    def watched_titles(self) -> DataFrame:
        """title, year of everything seen, whether rated or not."""
        return seen_titles([self.watched, self.diary, self.ratings, self.reviews], keys=())

    def summary(self) -> dict:
        """Counts and moments, for printing: one small aggregate for each table."""
        written = self.reviews.where(F.trim("review") != "").count() if "review" in self.reviews.columns else 0
        r = self.ratings.agg(F.count(F.lit(1)).alias("rated"), F.avg("rating").alias("mean"), F.stddev_samp("rating").alias("stdev"), F.min("rating").alias("least"), F.max("rating").alias("most")).first()
        return {"source": self.source, **r.asDict(), "diary": self.diary.count(), "written_reviews": written, "watchlist": self.watchlist.count(), "watched": self.watched.count(), "liked": self.likes.count(), "missing": list(self.missing)}


def column_name(header: str) -> str:
    h = header.strip().lstrip("\ufeff").lower()
    return "lb_uri" if h.endswith(_URI) else HEADERS.get(h, h)


def _typed(name: str, c: Column) -> Column:
    if name == "year":
        return c.try_cast("double").try_cast("int")
    if name == "rating":
        return c.try_cast("double")
    if name in ("logged_date", "watched_date"):
        return F.try_to_timestamp(c)
    if name == "rewatch":
        return F.coalesce(F.lower(strip(c)) == "yes", F.lit(False))
    if name in ("title", "lb_uri"):
        return strip(c)
    return c


def canonical(raw: DataFrame) -> DataFrame:
    """Canonical names and types; cells that can't be read become null; ``ord`` is the row's place. Of headers with one name the first counts."""
    rows = raw.withColumn("_at", F.monotonically_increasing_id())
    taken: dict[str, Column] = {}
    for at, h in enumerate(raw.columns):
        taken.setdefault(column_name(h), F.col(f"`{h}`"))
    return rows.select(*[_typed(n, c).alias(n) for n, c in taken.items()], F.col("_at").alias("ord"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted fields may hold line ends and doubled quotes."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, mode="FAILFAST")


def _in_folder(folder: Path, rel: str) -> Path | None:
    for f in (folder / rel, folder / Path(rel).name):
        if f.is_file():
            return f
    nested = sorted(c / rel for c in folder.iterdir() if c.is_dir() and c.name.lower() not in HIDDEN and (c / rel).is_file())
    return nested[0] if nested else None


def pick_member(names: list[str], rel: str) -> str | None:
    """The archive's member for ``rel``: the exact name in any case, else the shallowest that ends in it outside the hidden folders."""
    lowered = {n.lower(): n for n in names}
    if rel.lower() in lowered:
        return lowered[rel.lower()]
    inside = [n for low, n in lowered.items() if low.endswith("/" + rel.lower()) and not set(posixpath.dirname(low).split("/")) & set(HIDDEN)]
    return min(inside, key=lambda n: (n.count("/"), n), default=None)


def load_export(spark: SparkSession, path: str, shared_folder: str | None = None) -> Export:
    """Read an export. A ZIP's members are extracted to ``shared_folder`` (default: the session's checkpoint folder), which executors must see."""
    source = Path(path)
    if not source.exists():
        raise FileNotFoundError(f"no export at {path}")
    if source.is_dir():
        find = lambda rel: _in_folder(source, rel)
    elif source.suffix.lower() == ".zip":
        base = shared_folder or (spark.conf.get("spark.checkpoint.dir", "") or "").removeprefix("file://") or None
        folder = Path(mkdtemp(prefix="export-", dir=base))
        archive = zipfile.ZipFile(source)

        def find(rel: str) -> Path | None:
            member = pick_member(archive.namelist(), rel)
            if member is None:
                return None
            out = folder / rel.replace("/", "-")
            out.write_bytes(archive.read(member))
            return out
    else:
        raise ValueError(f"an export is a folder or a .zip, not {source.suffix or 'a file without a suffix'}")
    tables, missing = {}, []
    for name, rel in EXPORT_FILES.items():
        try:
            found = find(rel)
            table = canonical(read_csv(spark, str(found))) if found else None
            if table is not None:
                table.count()  # parse errors surface here, file by file
        except Exception:  # one broken file doesn't end the load
            table = None
        if table is None:
            missing.append(rel)
            table = spark.createDataFrame([], _EMPTY)
        tables[name] = table
    if "rating" not in tables["ratings"].columns or tables["ratings"].isEmpty():
        raise ValueError("the export has no usable ratings file")
    tables["ratings"] = tables["ratings"].where(F.col("rating").isNotNull())
    return Export(**tables, source=str(source), missing=missing)


def summary_row(ratings: DataFrame) -> DataFrame:
    """One row: n, n_titles, rating_mean, rating_stdev (sample), rating_min, rating_max."""
    return ratings.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("title").alias("n_titles"),
        F.avg("rating").alias("rating_mean"),
        F.stddev_samp("rating").alias("rating_stdev"),
        F.min("rating").alias("rating_min"),
        F.max("rating").alias("rating_max"),
    )
