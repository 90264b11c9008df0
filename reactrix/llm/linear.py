"""Linear text classifiers on n-gram indicators scaled by naive Bayes log-count ratios: toxicity and quality.

Class counts of every hashed n-gram come from all labelled rows, as per-task tables that are summed. All n-grams that they have are
features: a bounded sample of the labelled documents fits the linear model on them, in one task whose rows and feature places are both bounded by
parameters. Every whole text is then scored in Arrow batches; only model tables of a fixed size travel.

Defined results: null and empty texts get the score of a text without features; without labels of both classes all scores are
0.5 (one class: near that class); null labels don't teach, of several labels of one doc_id the larger holds; of rows that share a doc_id the sample takes one; rows with a null
doc_id are scored and not held out; repeated rows get equal results; very long texts are read whole, in pieces; extra columns are left out; empty tables
give empty results. Only doc_id, text and the label columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import bounded, clean_of, materialize

cloudpickle.register_pickle_by_value(grams)

#: Label rows that may be broadcast to the texts.
LABEL_ROWS = 4_000_000


def fold(doc_id: Column, parts: int, held: int) -> Column:
    """Whether crc32 of the id as text falls in the held-out part."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == held, F.lit(False))


@dataclass
class Settings:
    label: str
    parts: int
    held: int
    cut: float
    features: object
    bits: int
    squared: bool
    #: Documents of the fitting sample, and the places of n-grams that they may have in all.
    sample: int = 4000
    places: int = 1 << 25
    cost: float = 1.0
    epochs: int = 10
    smooth: float = 1.0


TOXICITY = Settings("toxic", 4, 2, 0.3, grams.char_grams((3, 4, 5), 18, True), 18, True, cost=0.03, epochs=6, smooth=3.0)
QUALITY = Settings("quality", 3, 1, 0.5, grams.quality_grams((1, 2, 3), (1, 2, 3), 16), 16, False)


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0


def taught(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """doc_id, text, y of the rows that may teach."""
    y = clean_of(labels, "doc_id", s.label).where(F.col(s.label).isin(0, 1) & F.col("doc_id").isNotNull() & ~fold(F.col("doc_id"), s.parts, s.held))
    y = y.groupBy(F.col("doc_id").alias("of_doc")).agg(F.max(F.col(s.label)).cast("int").alias("y"))
    n = y.count()
    return clean_of(docs, "doc_id", "text").join(bounded(y, n, LABEL_ROWS), F.col("doc_id") == F.col("of_doc")).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, s: Settings) -> Model:
    rows = taught(docs, labels, s)
    counts = materialize(rows.select("text", "y").mapInArrow(grams.class_counts(s.features, s.bits), "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "counts")
    texts = counts.where("bucket = -1").first()
    if texts is None or texts.n0 + texts.n1 == 0:
        return Model()
    if not texts.n0 or not texts.n1:
        return Model(bias=4.0 if texts.n1 else -4.0)
    n0, n1, smooth = F.lit(float(texts.n0)), F.lit(float(texts.n1)), F.lit(s.smooth)
    # indicators: shares of the texts of each class that have the n-gram
    p1, p0 = (F.col("n1") + smooth) / (n1 + 2 * smooth), (F.col("n0") + smooth) / (n0 + 2 * smooth)
    told = counts.where("bucket >= 0").select("bucket", F.log(p1 / p0).alias("ratio")).toPandas()  # 2 ** bits rows at most
    ratios = np.zeros(1 << s.bits)
    ratios[told["bucket"].to_numpy(np.int64)] = told["ratio"].to_numpy(float)
    share = min(1.0, s.sample / (texts.n0 + texts.n1))
    picked = rows.select(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(s.label)), 1).alias("pick"), "text", "y").where(F.col("pick") <= min(int(share * (1 << 63)), (1 << 63) - 1))
    # one row for each document: what rows share an id is left behind before the shuffle
    picked = picked.groupBy("pick").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
    x = picked.mapInArrow(grams.selected(s.features, s.bits), "pick bigint, y int, x binary")
    got = x.repartition(1).sortWithinPartitions("pick").mapInArrow(grams.fit(ratios, s.cost, s.squared, s.epochs, s.sample, s.places), "w binary, a double, b double").first()
    if got is None:
        return Model()
    w = np.frombuffer(got.w, np.float32)
    return Model((w[:-1] * ratios).astype(np.float32), float(w[-1]), got.a, got.b)


def score(docs: DataFrame, model: Model, s: Settings) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each input row."""
    rows = clean_of(docs, "doc_id", "text").select("doc_id", fold(F.col("doc_id"), s.parts, s.held).alias("held_out"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return rows.mapInArrow(grams.scorer(s.features, s.bits, model.weights, model.bias, model.a, model.b, s.cut), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels, TOXICITY), TOXICITY)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels, QUALITY), QUALITY)
