"""Boosted trees for several classes at once: softmax gradients, binned features, histograms summed by Spark.

Features are binned by quantiles of their values (an absent feature is bin 0). In each round every class gets a tree, and all trees of a round grow together: a
level is one pass over the rows, in which tasks sum gradients by class, node, feature and bin; Spark adds the sums up and finds each node's best split, and the
driver gets one row for each node. Rounds end where the loss of all classes on validation rows stops falling. Rows' margins aren't kept: they follow from the trees, which are small.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array  # noqa: F401  (registers the vector type)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import stored


@dataclass
class Boosted:
    """Trees by round and class: arrays of feature (-1 at leaves), cut (bins above it go right) and value, nodes as in a heap."""

    classes: int
    depth: int
    rounds: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=list)
    #: Quantile cuts of each feature's values: the bin is 1 + the number of cuts below the value.
    cuts: dict[int, np.ndarray] = field(default_factory=dict)
    #: Mean loss of the validation rows before each round, and of the training rows.
    held_losses: list[float] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)


def sparse(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, idx, val: the places and values of a vector column ``features`` that aren't zero."""
    v = F.unwrap_udt("features")
    dense = F.filter(F.transform(v["values"], lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    pairs = F.when(v["type"] == 0, F.filter(F.arrays_zip(v["indices"].alias("i"), v["values"].alias("x")), lambda p: p["x"] != 0)).otherwise(dense)
    return rows.select(*keep, pairs.alias("p")).select(*keep, F.transform("p", lambda p: p["i"].cast("int")).alias("idx"), F.transform("p", lambda p: p["x"]).alias("val"))


def cuts_of(rows: DataFrame, bins: int) -> dict[int, np.ndarray]:
    """Quantiles of each feature's values: max_features x bins numbers."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    each = rows.select(F.explode(F.arrays_zip("idx", "val")).alias("p")).groupBy(F.col("p.idx").alias("i")).agg(F.percentile_approx("p.val", shares, 1000).alias("cuts"))
    return {r.i: np.unique(np.array(r.cuts)) for r in each.collect()}


def binned(sent, keep: list[str]):
    """Batches (keep, idx, val) to (keep, idx, bin)."""
    def run(batches):
        for b in batches:
            idx, val = b.column("idx").flatten().to_numpy(), b.column("val").flatten().to_numpy()
            out = np.ones(len(idx), np.int32)
            order = np.argsort(idx, kind="stable")
            edges = np.flatnonzero(np.diff(np.concatenate(([-1], idx[order], [-1]))))
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                at = order[a:z]
                out[at] += np.searchsorted(sent.value.get(int(idx[at[0]]), np.zeros(0)), val[at], "left").astype(np.int32)
            offsets = pa.array(b.column("idx").offsets.to_numpy() - b.column("idx").offsets[0].as_py(), pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.ListArray.from_arrays(offsets, pa.array(idx)), pa.ListArray.from_arrays(offsets, pa.array(out))], names=[*keep, "idx", "bin"])

    return run


def rows_of(batch):
    """(row of each entry, feature, bin, rows)."""
    sizes = np.diff(batch.column("idx").offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), batch.column("idx").flatten().to_numpy(), batch.column("bin").flatten().to_numpy(), len(sizes)


def places(trees, row, feature, bin_, n: int) -> np.ndarray:
    """The node that each row reaches in each tree, as far as the trees have grown."""
    used = np.unique(np.concatenate([f[f >= 0] for f, _, _ in trees] + [np.zeros(0, int)]).astype(int))
    table = np.zeros((n, len(used) + 1), np.int32)
    at = np.searchsorted(used, feature)
    known = (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == feature) if len(used) else np.zeros(len(feature), bool)
    table[row[known], at[known]] = bin_[known]
    out = np.zeros((n, len(trees)), np.int64)
    for k, (f, cut, _) in enumerate(trees):
        place = np.searchsorted(used, np.maximum(f, 0)) if len(used) else np.zeros(len(f), int)
        node = out[:, k]
        while len(f) > 1:
            inner = f[node] >= 0
            if not inner.any():
                break
            right = table[np.arange(n), np.where(inner, place[node], 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        out[:, k] = node
    return out


def margins(model_rounds, classes: int, row, feature, bin_, n: int) -> np.ndarray:
    trees = [t for r in model_rounds for t in r]
    out = np.zeros((n, classes))
    if trees:
        node = places(trees, row, feature, bin_, n)
        for k, (_, _, value) in enumerate(trees):
            out[:, k % classes] += value[node[:, k]]
    return out


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def histograms(sent):
    """Sums of gradients (g, h) by class, node, feature and bin over training rows; feature -1: of a node; node -1: loss and weight of training (class 0) and validation rows (class 1)."""
    def run(batches):
        rounds, growing, classes, level = sent.value
        first, width = (1 << level) - 1, 1 << level
        total = np.zeros((classes, width, 2))
        loss, sums = np.zeros((2, 2)), {}
        for b in batches:
            if not len(b):
                continue
            row, feature, bin_, n = rows_of(b)
            p = softmax(margins(rounds, classes, row, feature, bin_, n))
            label, weight = b.column("label").to_numpy(), b.column("weight").to_numpy()
            held = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
            own = weight * -np.log(np.maximum(p[np.arange(n), label], 1e-15))
            for k, some in ((0, ~held), (1, held)):
                loss[k] += own[some].sum(), weight[some].sum()
            w = np.where(held, 0.0, weight)
            g = w[:, None] * (p - (label[:, None] == np.arange(classes)))
            h = w[:, None] * np.maximum(p * (1 - p), 1e-16)
            node = places(growing, row, feature, bin_, n) - first
            for k in range(classes):
                live = (node[:, k] >= 0) & (node[:, k] < width) & ~held
                for j, x in ((0, g), (1, h)):
                    total[k, :, j] += np.bincount(node[live, k], x[live, k], width)
                on = live[row]
                key = (np.where(on, node[row, k], 0) << 40) | (feature.astype(np.int64) << 8) | bin_
                keys, at = np.unique(key[on], return_inverse=True)
                found = np.stack([np.bincount(at, x[row[on], k], len(keys)) for x in (g, h)], 1)
                old = sums.get(k)
                if old is not None:
                    keys, at = np.unique(np.concatenate([old[0], keys]), return_inverse=True)
                    every = np.concatenate([old[1], found])
                    found = np.stack([np.bincount(at, every[:, j], len(keys)) for j in (0, 1)], 1)
                sums[k] = (keys, found)
        names = ["class", "node", "feature", "bin", "g", "h"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        heads = [(k, first + j, -1, 0, *total[k, j]) for k in range(classes) for j in range(width) if total[k, j, 1] > 0] + [(k, -1, -1, 0, *loss[k]) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*heads, strict=True), kinds, strict=True)], names=names)
        for k, (keys, found) in sums.items():
            columns = [np.full(len(keys), k), first + (keys >> 40), keys >> 8 & 0xFFFFFFFF, keys & 0xFF, found[:, 0], found[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def splits(sums: DataFrame, ridge: float, least: float) -> DataFrame:
    """class, node, g, h, and the node's best split: feature, bin (rows above it go right), right_g, right_h, gain (none: null). Ties go to the least feature, then bin."""
    nodes = sums.where("feature = -1 and node >= 0").select(F.col("class").alias("c"), F.col("node").alias("n"), F.col("g").alias("all_g"), F.col("h").alias("all_h"))
    above = Window.partitionBy("class", "node", "feature").orderBy(F.col("bin").desc())  # a feature's bins
    right = sums.where("feature >= 0").select("class", "node", "feature", (F.col("bin") - 1).alias("cut"), F.sum("g").over(above).alias("right_g"), F.sum("h").over(above).alias("right_h"))
    met = right.join(F.broadcast(nodes), (F.col("class") == F.col("c")) & (F.col("node") == F.col("n")))  # the nodes of one level
    score = lambda g, h: g * g / (h + ridge)
    g, h = F.col("all_g") - F.col("right_g"), F.col("all_h") - F.col("right_h")
    gain = F.round(score(F.col("right_g"), F.col("right_h")) + score(g, h) - score(F.col("all_g"), F.col("all_h")), 9)
    best = met.withColumn("gain", gain).where((F.col("gain") > 1e-6) & (F.col("right_h") >= least) & (h >= least))
    best = best.groupBy("class", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("cut")).alias("b"), "right_g", "right_h")).alias("best"))
    return nodes.join(best, (F.col("class") == F.col("c")) & (F.col("node") == F.col("n")), "left").select("c", "n", "all_g", "all_h", "best")


def fit(rows: DataFrame, classes: int, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: float = 1e-3, bins: int = 8, patience: int = 3) -> Boosted:
    """rows: features (a vector), label (0 to classes - 1), weight, held (validation rows, which don't teach). Without validation rows all rounds are made."""
    own = sparse(rows.withColumns({"label": F.col("label").cast("int"), "weight": F.col("weight").cast("double")}), "label", "weight", "held")
    model = Boosted(classes, depth, cuts=cuts_of(own.where("not held"), bins))
    spark, keep = rows.sparkSession, ["label", "weight", "held"]
    table = stored(own.mapInArrow(binned(spark.sparkContext.broadcast(model.cuts), keep), "label int, weight double, held boolean, idx array<int>, bin array<int>"), "binned")
    best = 0
    for done in range(rounds + 1):
        size = (1 << (depth + 1)) - 1
        growing = [(np.full(size, -1), np.zeros(size, int), np.zeros(size)) for _ in range(classes)]
        for level in range(depth):
            sent = spark.sparkContext.broadcast((model.rounds, growing, classes, level))
            sums = stored(table.mapInArrow(histograms(sent), "class int, node int, feature int, bin int, g double, h double").groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")), "sums")
            if level == 0:
                loss = {r["class"]: r.g / r.h if r.h else float("nan") for r in sums.where("node = -1").collect()}
                model.losses.append(loss.get(0, float("nan")))
                model.held_losses.append(loss.get(1, float("nan")))
                best = len(model.held_losses) - 1 if np.isnan(model.held_losses[-1]) else int(np.nanargmin(model.held_losses))
                if done == rounds or done - best >= patience:
                    model.rounds = model.rounds[:best]
                    return model
            found = splits(sums, ridge, least).collect()  # classes x 2 ^ level rows
            for r in found:
                f, cut, value = growing[r.c]
                value[r.n] = -rate * r.all_g / (r.all_h + ridge)
                if r.best is not None:
                    f[r.n], cut[r.n] = -r.best.f, -r.best.b
                    g, h = r.best.right_g, r.best.right_h
                    value[2 * r.n + 1], value[2 * r.n + 2] = -rate * (r.all_g - g) / (r.all_h - h + ridge), -rate * g / (h + ridge)
        model.rounds.append(growing)
    return model


def transform(model: Boosted, rows: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, ``scores`` (a probability for each class) and ``prediction`` of rows with features."""
    spark = rows.sparkSession
    sent, cuts = spark.sparkContext.broadcast((model.rounds, model.classes)), spark.sparkContext.broadcast(model.cuts)
    own = sparse(rows, *keep)
    schema = ", ".join(f"`{c}` {t}" for c, t in own.dtypes if c in keep)

    def run(batches):
        for b in binned(cuts, list(keep))(batches):
            rounds, classes = sent.value
            p = softmax(margins(rounds, classes, *rows_of(b))) if len(b) else np.zeros((0, classes))
            scores = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * classes, pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], scores, pa.array(p.argmax(axis=1) if len(p) else [], pa.int32())], names=[*keep, "scores", "prediction"])

    return own.mapInArrow(run, f"{schema}, scores array<double>, prediction int")
