"""Toxicity and quality: FTRL-proximal logistic regression over hashed word n-grams.

Fitting: at most ``max_rows`` labelled documents (those with the smallest hash of their id; a documented
bound) are joined with a broadcast of the chosen ids, turned into hashed slots on the executors (at most 2**bits of them for a text,
however long), reduced to one row for each id and label before they meet, and fitted in one executor task. What reaches the driver is the sparse model: the weights that L1 left, at most
2**bits of 12 bytes (in practice some hundreds), which is broadcast for scoring. Scoring is one pass over
whole texts without a shuffle.

Defined cases: a null text scores like an empty one; an empty text scores by the bias alone (and, for
quality, its length bucket); rows with a null label or id aren't learnt from; without labelled rows every
score is 0.5; of rows that share an id the text with the least hash is learnt from; repeated rows and ties are scored row by row; an existing column with the name of the
output is replaced, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear
from .frames import bounded, bucket, position, with_arrays
from .ftrl import Ftrl, Model
from .words import texts

MAX_ROWS = 8_000


@dataclass(frozen=True)
class Kind:
    """What differs between the two classifiers."""

    label: str
    config: Ftrl
    features: Callable
    scores: Callable


TOXICITY = Kind("toxic", linear.TOXIC, linear.toxic_features, linear.toxic_scores)
QUALITY = Kind("quality", linear.QUALITY, linear.quality_features, linear.quality_scores)


def fit(docs: DataFrame, labels: DataFrame, kind: Kind, learn: Column | None = None, id_column: str = "doc_id", text_column: str = "text", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The sparse model (indices, weights; index -1 is the bias). ``learn``: which label rows may be used."""
    rows = labels.where(F.col(id_column).isNotNull() & F.col(kind.label).isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    rows = rows.select(F.col(id_column), F.col(kind.label).cast("double").alias("_label"), F.xxhash64(F.col(id_column).cast("string")).alias("_order"))
    sample = rows.orderBy("_order", "_label").limit(max_rows)  # top-n: no full sort, max_rows short rows
    texts_of = docs.select(F.col(id_column), F.col(text_column).alias("_text")).join(F.broadcast(sample), id_column)
    bits, config, features = kind.config.bits, kind.config, kind.features
    slim = texts_of.select("_label", "_order", "_text", F.xxhash64("_text").alias("_pick"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(features(texts(batch.column(2)), bits))
            slots = pa.array([x.astype(np.int32).tobytes() for x, _ in found], pa.binary())
            values = pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), slots, values], ["_label", "_order", "_pick", "_slots", "_values"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
        got.sort(key=lambda x: (x[1], x[0]))
        index, weight = config.fit([(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for _, _, s, v in got], np.array([x[0] for x in got]))
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(weight, pa.float64())], ["at", "weight"])

    extracted = bounded(slim).mapInArrow(extract, "_label double, _order long, _pick long, _slots binary, _values binary")
    one = extracted.groupBy("_label", "_order").agg(F.min_by(F.struct("_slots", "_values"), "_pick").alias("_x"))
    model = one.select("_label", "_order", "_x._slots", "_x._values").repartition(1).mapInArrow(train, "at long, weight double").toArrow()
    return model["at"].to_numpy(), model["weight"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], kind: Kind, text_column: str = "text", output: str = "score") -> DataFrame:
    """docs with ``output``: the probability of label 1, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, bits, scores = position(docs, text_column), kind.config.bits, kind.scores

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        dense = Model(bits, *shared.value)
        for batch in batches:
            yield batch, {output: pa.array(scores(batch.column(at), dense), pa.float64())}

    return with_arrays(docs, [T.StructField(output, T.DoubleType())], compute)


def judged(docs: DataFrame, labels: DataFrame, kind: Kind, threshold: float, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; fold 0 of ``folds`` isn't learnt from."""
    model = fit(docs, labels, kind, bucket("doc_id", folds) != 0)
    scored = score(docs.select("doc_id", "text"), model, kind)
    return scored.select("doc_id", F.coalesce(bucket("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
