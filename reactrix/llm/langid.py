"""Language identification with a blended-spectrum string kernel.

The kernel counts the n-grams (orders 1 to 3, as presence) that two texts share, normalised by what each has. Landmark
texts of every language span a Nyström feature space, in which one-versus-rest kernel ridge regression is solved in closed
form. Scoring a batch is one product of its presence matrix with the landmarks' and one with the solution.

The fit uses a bounded sample, ``per_lang`` distinct texts of a language at most and SAMPLE in all, reduced on the executors to presence bits, and MARKS landmarks at most
(one text, and one landmark, of each language in any case). Sums of its normal equations are taken block by block.

Defined results: null texts and texts without a letter (a character of Unicode category L: no digits, other numbers, marks or signs) are ``und`` with score 0;
without any learned language so are all; null langs don't teach; of equally likely languages the first by name wins; repeated rows teach once and get equal results; very long texts
are read whole, in pieces; extra columns are left out; empty tables give empty results. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grams
from .common import bounded, clean_of, materialize
from .linear import fold

cloudpickle.register_pickle_by_value(grams)

ORDERS, BITS = (1, 2, 3), 14
#: Texts of the sample and landmarks, over all languages; texts whose presence bits are unpacked at a time.
SAMPLE, MARKS, ROWS = 12_000, 1_600, 512


def train(docs: DataFrame, per_lang: int = 300, landmarks: int = 24, ridge: float = 1e-2, parts: int = 3, held: int = 1):
    """(packed landmarks, solution, language names)."""
    rows = clean_of(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold(F.col("doc_id"), parts, held))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("count"))
    sizes = materialize(sizes, "sizes")
    langs = max(1, sizes.count())
    per_lang, landmarks = max(1, min(per_lang, SAMPLE // langs)), max(1, min(landmarks, MARKS // langs))
    # twice as many texts as wanted are expected to pass, by their hash; of these the first are taken
    wanted = sizes.select(F.col("lang").alias("of_lang"), (F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.col("count")) * F.lit(float(1 << 63))).alias("least_hash"))
    rows = rows.withColumn("pick", F.shiftrightunsigned(F.xxhash64("text"), 1)).join(bounded(wanted, wanted.count(), 10_000), F.col("lang") == F.col("of_lang")).where(F.col("pick") <= F.col("least_hash"))
    passed = materialize(rows.groupBy("lang", "pick").agg(F.first("text").alias("text")), "passed")
    first = passed.select("lang", "pick").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("pick"))).where(F.col("n") <= per_lang).drop("n")
    sample = passed.join(F.broadcast(first), ["lang", "pick"]).select("lang", "text").mapInArrow(grams.packed_presence(ORDERS, BITS), "lang string, x binary").toPandas().sort_values(["lang", "x"], kind="stable")
    if not len(sample):
        return np.zeros((0, (1 << BITS) // 8), np.uint8), np.zeros((0, 0)), []
    names = sorted(sample["lang"].unique())
    packed = np.stack([np.frombuffer(x, np.uint8) for x in sample["x"]])
    of = np.searchsorted(np.array(names), sample["lang"].to_numpy())
    # the longest texts say most of their language: landmarks are taken evenly over each language's sample by size
    sizes_ = np.concatenate([np.unpackbits(packed[a : a + ROWS], axis=1).sum(axis=1, dtype=np.float32) for a in range(0, len(packed), ROWS)])
    chosen = np.concatenate([own[np.argsort(sizes_[own], kind="stable")][np.unique(np.linspace(len(own) // 2, len(own) - 1, landmarks).astype(int))] for own in (np.flatnonzero(of == k) for k in range(len(names)))])
    marks = np.unpackbits(packed[chosen], axis=1).astype(np.float32)
    values, vectors = np.linalg.eigh(grams.kernel(marks, marks).astype(float))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    square, aim = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(names)))
    for a in range(0, len(packed), ROWS):
        phi = grams.kernel(np.unpackbits(packed[a : a + ROWS], axis=1).astype(np.float32), marks).astype(float) @ root
        square, aim = square + phi.T @ phi, aim + phi.T @ np.where(of[a : a + ROWS, None] == np.arange(len(names)), 1.0, -1.0)
    solved = root @ np.linalg.solve(square + ridge * np.eye(root.shape[1]), aim)
    return packed[chosen], solved.astype(np.float32), [str(x) for x in names]


def identify(docs: DataFrame, model, sharp: float = 3.0, parts: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each input row."""
    packed, solved, names = model
    rows = clean_of(docs, "doc_id", "text").select("doc_id", fold(F.col("doc_id"), parts, held).alias("held_out"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(grams.language_scorer(ORDERS, BITS, packed, solved, names, sharp), schema)


def language(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
