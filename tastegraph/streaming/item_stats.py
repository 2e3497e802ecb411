"""Item statistics kept up from a stream of events: the incremental form of the batch aggregate."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def item_stats(events: DataFrame) -> DataFrame:
    """item, n_events, mean_value, last_ts of a batch or stream of events. State is one row for each item."""
    rows = events.select(F.get_json_object("props", "$.k").cast("long").alias("item"), "value", "ts")
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("mean_value"), F.max("ts").alias("last_ts"))


def windowed_activity(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """window start, item, n_events: tumbling windows; events later than the watermark are dropped and closed windows leave the state."""
    rows = events.select(F.get_json_object("props", "$.k").cast("long").alias("item"), "ts").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length), "item").agg(F.count(F.lit(1)).alias("n_events")).select(F.col("window.start").alias("start"), "item", "n_events")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    parent, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's result once it has read what is there now: each trigger's table replaces the one before in the folder of spark.checkpoint.dir, where the
    stream's own state is kept as well (a folder of this machine only if the session names none, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stream-")
    out = f"{base.rstrip('/')}/item_stats_{uuid4().hex}"
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/table")
    running = item_stats(stream(spark, sf_dir)).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{out}/table")
