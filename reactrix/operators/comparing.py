"""Several linear models side by side: one scan scores all of them as one stacked matrix, with a fallback for models that are missing, and their vote."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation
from .boosting import sparse
from .learning import TEXT, Classifier, Features, train_one, weighted
from .ranges import stored
from .vectors import Vectorizer


@dataclass
class Linear:
    """A linear model over shared features: a row of coefficients for each label. kind: how scores become confidences, ``probability`` (softmax) or ``margin`` (logistic of the best)."""

    name: str
    f1: float
    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    kind: str


def linear(name: str, f1: float, fitted: Classifier) -> Linear:
    """The coefficients of a fitted logistic regression or of one-vs-rest linear support vectors."""
    m = fitted.models[0]
    if hasattr(m, "coefficientMatrix"):
        weights, bias = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
        if len(weights) == 1:  # two labels in one row
            weights, bias = np.vstack([-weights / 2, weights / 2]), np.array([-bias[0] / 2, bias[0] / 2])
        return Linear(name, f1, fitted.labels, weights, bias, "probability")
    return Linear(name, f1, fitted.labels, np.vstack([x.coefficients.toArray() for x in m.models]), np.array([x.intercept for x in m.models]), "margin")


def chained(wanted: list[str], found: dict[str, Linear], fallback: str) -> list[tuple[str, Linear, str]]:
    """(wanted name, model, note): a model that isn't there is replaced by the fallback, or by the best there is."""
    if not found:
        raise ValueError("none of the models is there")
    spare = found.get(fallback) or max(found.values(), key=lambda m: (m.f1, m.name))
    return [(n, found[n], "") if n in found else (n, spare, f"fallback to {spare.name}") for n in wanted]


def compared(rows: DataFrame, key: str, models: list[tuple[str, Linear, str]]) -> DataFrame:
    """key, model_name, place (by F1, from 1), f1, y_pred, confidence, note, vote, votes: a row for each row with features and model.

    place: the better F1 first, then the name. vote: the label most models say; of labels with as many votes that of the best placed model. Each row is
    scored once for all models.
    """
    ranked = sorted(models, key=lambda m: (-m[1].f1, m[0]))
    own = sparse(rows, key)
    distinct = list({id(m): m for _, m, _ in ranked}.values())
    at = {id(m): k for k, m in enumerate(distinct)}
    bounds = np.cumsum([0, *[len(m.labels) for m in distinct]])
    sent = rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(np.vstack([m.weights for m in distinct]).T), np.concatenate([m.bias for m in distinct])))
    kinds, labels = [m.kind for m in distinct], [m.labels for m in distinct]

    def run(batches):
        weights, bias = sent.value
        for b in batches:
            if not len(b):
                continue
            offsets, idx, val = b.column("idx").offsets.to_numpy(), b.column("idx").flatten().to_numpy(), b.column("val").flatten().to_numpy()
            offsets = offsets - offsets[0]
            scores = np.stack([val[a:z] @ weights[idx[a:z]] + bias if z > a else bias for a, z in zip(offsets[:-1], offsets[1:], strict=True)])
            said, sure = [], []
            for k, kind in enumerate(kinds):
                s = scores[:, bounds[k] : bounds[k + 1]]
                best = s.argmax(axis=1)
                top = s[np.arange(len(s)), best]
                said.append([labels[k][j] for j in best])
                sure.append(1 / np.exp(s - top[:, None]).sum(axis=1) if kind == "probability" else 1 / (1 + np.exp(-top)))
            lists = pa.array([list(x) for x in zip(*said, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(key), lists, pa.array([list(map(float, x)) for x in zip(*sure, strict=True)], pa.list_(pa.float64()))], names=[key, "said", "sure"])

    scored = own.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, said array<string>, sure array<double>")
    told = F.array(*[F.struct(F.lit(n).alias("model_name"), F.lit(k + 1).alias("place"), F.lit(float(m.f1)).alias("f1"), F.get("said", F.lit(at[id(m)])).alias("y_pred"), F.get("sure", F.lit(at[id(m)])).alias("confidence"), F.lit(note).alias("note")) for k, (n, m, note) in enumerate(ranked)])
    rows = scored.select(key, told.alias("told"))
    said = F.transform("told", lambda t: t["y_pred"])
    count = lambda x: F.size(F.filter(said, lambda y: y == x))
    votes = F.transform("told", lambda t: F.struct(count(t["y_pred"]).alias("votes"), (-t["place"]).alias("first"), t["y_pred"].alias("label")))
    return rows.withColumn("won", F.array_max(votes)).select(key, F.explode("told").alias("t"), "won").select(key, "t.*", F.col("won.label").alias("vote"), F.col("won.votes").alias("votes"))


def fit_all(train: DataFrame, val: DataFrame, wanted: dict[str, tuple[str, dict]], labels: list[str], **text) -> tuple[Vectorizer, dict[str, Linear]]:
    """Linear models over shared features, by name: (family, settings) each, with their macro F1 on the validation rows, which one scan scores for all of them."""
    features = Features(weighted(train), val)
    found: dict[str, Linear] = {}
    for name, (family, p) in wanted.items():
        fitted = train_one(family, features.train, None, {k: v for k, v in p.items() if k not in TEXT} | text, features)
        found[name] = linear(name, 0.0, fitted)
    texts = features.texts(text)
    scored = stored(compared(texts.transform(val.select("record_id", "y_true", "text")), "record_id", chained(list(found), found, "")).join(val.select("record_id", "y_true"), "record_id"), "scored")
    for name, m in found.items():
        m.f1 = float(evaluation.overall(scored.where(F.col("model_name") == name), labels).first().macro_f1)
    return texts, found
