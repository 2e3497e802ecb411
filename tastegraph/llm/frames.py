"""Arrow-batch helpers that the operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: Rows and bytes of an Arrow batch at most: a Python worker's memory then follows neither the table nor the setting's default of 10,000 texts.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches bounded (smaller settings stay). Spark reads both settings when a query runs, so they hold for the session from here on."""
    conf = df.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "0"))
    if not 0 < rows <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def with_arrays(df: DataFrame, fields: list[T.StructField], compute: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, dict]]]) -> DataFrame:
    """All columns of df and new ones, made batch by batch in Python workers.

    A column of df with the name of a new one (in any case) is replaced. ``compute`` maps an iterator of
    batches to (batch, {name: array}) and sees every column of df.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    places = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in compute(batches):
            arrays = [batch.column(i) for i in places] + [x if isinstance(x := got[f.name], pa.Array) else pa.array(x) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + [f.name for f in fields])

    return bounded(df).mapInArrow(run, T.StructType([*kept, *fields]))


def held(docs: DataFrame, *columns: str) -> DataFrame:
    """Some columns of docs, and all others as one struct ``row``: what operators add can't clash with a caller's names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in columns] or [F.lit(True).alias("none")]
    return docs.select(F.struct(*rest).alias("row"), *columns)


def released(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs from what ``held`` made of them, some of them changed."""
    inside = df.schema["row"].dataType.names
    return df.select(*[changed.get(c, F.col("row").getField(c) if c in inside else F.col(c)).alias(c) for c in docs.columns])


def position(df: DataFrame, name: str) -> int:
    """Where a column stands (names in any case, the first if several)."""
    return [x.lower() for x in df.columns].index(name.lower())


#: Steps after which the driver collects its garbage.
RELEASE = 3
_steps = count(1)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir, its lineage cut; that folder is set here only if the session has none (tests).

    Spark drops the shuffle files (and checkpoints, if it is set to) of finished steps when the driver collects its garbage, which may be long after: a
    query of many steps would fill the executors' disks with files that nothing reads any more. So it is asked to every few steps."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    out = df.checkpoint()
    if next(_steps) % RELEASE == 0:
        gc.collect()
        context._jvm.System.gc()
    return out
