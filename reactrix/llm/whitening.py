"""Embedding whitening by a randomised range finder.

Vectors become integers (x = floor(64 * c) + 1000000), whose sums are exact. A random basis, wider than the wanted components by an oversampling,
is multiplied by the covariance in passes over all centred rows, and made orthonormal after each; the covariance itself is never formed.
Rayleigh-Ritz on the basis gives components, and their residuals tell whether they are right to double precision. If they aren't after the
last power pass, the basis grows to the full dimension, where Rayleigh-Ritz is exact. A pass adds up one product for each task, by
its rows, in two steps; what the driver gets is one matrix of dimension x basis, whatever the number of vectors.

Defined results: null vectors, and those with null, non-finite or huge entries (|64 c| of 2^52 and more), are dropped; so are those whose length isn't the most common one (of equally
common lengths the greatest). Null and repeated ids stay, repeated rows get equal results and count as often as they occur. A component without variance (below 1e-10 of the greatest) can't be whitened and is
left out, so equal vectors, or a single one, give no rows; of equal eigenvalues the order is that of the solver, alike for all rows. A deviation beyond a long is null. Empty
tables give empty results. Extra columns are left out. Vectors' length is bounded by memory alone: a batch holds batch x dimension numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passes
from .common import clean_of

cloudpickle.register_pickle_by_value(passes)

COMPONENTS, OVERSAMPLING, POWER_PASSES, SEED = 32, 8, 3, 20240611
#: Greatest residual |V u - e u| of a component, as a share of the first eigenvalue.
RESIDUAL = 1e-13
#: Least eigenvalue of a component, as a share of the first.
LEAST = 1e-10
#: Groups that the products of tasks are added up in first.
GROUPS = 32


@dataclass
class Whitening:
    """What the fit found: exact sums, and unit components (columns) with their eigenvalues, falling."""

    n: int
    sums: list[int]
    trace: float
    components: np.ndarray
    values: np.ndarray
    #: Width of the basis that the components come from, and its passes over the rows.
    width: int
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    @property
    def axes(self) -> np.ndarray:
        """Whitened values are centred vectors times this."""
        return self.components / np.sqrt(self.values)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector of the rows that take part, the key as ``vec_id`` and the vector as ``embedding``."""
    rows = clean_of(vectors, key, vector).toDF("vec_id", "embedding")
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(1 << 46)))
    rows = rows.where(fine & (F.size("embedding") > 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return rows.where(F.size("embedding") == (common.d if common else 0))


def added(rows: DataFrame, product) -> np.ndarray:
    """The sum of a product, an array with one row of numbers for each output row, over all batches of rows.

    Tasks emit one sum each; sums are added by output row in GROUPS groups, then in one. Both steps add in the order of tasks, so that reruns agree.
    """
    parts = rows.select("embedding").mapInArrow(passes.task_sums(product), "line int, task int, sums binary")
    first = parts.withColumn("task", F.col("task") % GROUPS).withColumn("of", F.col("task"))
    total = first.groupBy("line", "of").applyInArrow(passes.add_up, "line int, task int, sums binary").groupBy("line").applyInArrow(passes.add_up, "line int, task int, sums binary")
    got = {r.line: np.frombuffer(r.sums) for r in total.collect()}  # as many rows as the product has
    return np.stack([got[k] for k in range(len(got))]) if got else np.zeros((0, 0))


def fit(rows: DataFrame, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, power_passes: int = POWER_PASSES, residual: float = RESIDUAL, seed: int = SEED) -> Whitening | None:
    """The whitening of usable() rows; None where there is no row or no variance."""
    sums = passes.joined(rows.select("embedding").mapInArrow(passes.task_totals, "line int, n bigint, high bigint, low bigint").groupBy("line").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect())
    if sums is None:
        return None
    n, total = sums
    d = len(total)
    center = passes.center(n, total)
    trace = float(added(rows, passes.squares(center)).sum()) / n
    if not trace:
        return None
    rng = np.random.default_rng(seed)
    width = min(d, components + oversampling)
    basis, done = np.linalg.qr(rng.standard_normal((d, width)))[0], 0
    while True:
        image = added(rows, passes.covariance_times(center, basis)) / n
        done += 1
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
        found = basis @ turn
        lost = np.linalg.norm(image @ turn - found * values, axis=0).max()
        if lost <= residual * values[0] or width == d:
            break
        if done <= power_passes:
            basis = np.linalg.qr(image)[0]
        else:  # the range is not found: all of the space is
            width = d
            basis = np.linalg.qr(np.hstack([np.linalg.qr(image)[0], rng.standard_normal((d, d - image.shape[1]))]))[0]
    keep = values > LEAST * values[0]
    found = found[:, keep]
    return Whitening(n, total, trace, found / np.linalg.norm(found, axis=0), values[keep], width, done)


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, in one more pass."""
    k = len(w.values)
    sums = added(rows, passes.moments(passes.center(w.n, w.sums), w.axes)) / w.n
    covariance, mean = sums[:k], sums[k]
    return float(np.abs(covariance - np.outer(mean, mean) - np.eye(k)).max())


def transform(rows: DataFrame, w: Whitening) -> DataFrame:
    """vec_id, deviation (exact, null beyond a long) and whitened (an array, one value for each component) of usable() rows."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(passes.whitener(w.n, w.sums, w.axes), f"vec_id {kind}, deviation bigint, whitened array<double>")


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    rows = usable(vectors, key, vector)
    kind = rows.schema["vec_id"].dataType.simpleString()
    w = fit(rows, components)
    if w is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    error = identity_error(rows, w)
    shares = F.array(*[F.lit(float(x)) for x in w.explained])
    long = transform(rows, w).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return long.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
