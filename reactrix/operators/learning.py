"""Text classifiers: candidates, trials, final fits, inference. Features are the TF-IDF vectors of vectors.py; models are Spark's own."""

from __future__ import annotations

import hashlib
import json
import math
import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import boosting, evaluation
from .ranking import best_in_group
from .ranges import stored
from .vectors import Vectorizer

#: What makes a fit fail; anything else, such as a lost executor, is no candidate's fault and ends the run.
FAILURES = (IllegalArgumentException, AnalysisException, ValueError)

# Most candidates of a model in the quick and in the deep search.
MOST = {"LogisticRegression": 12, "LinearSVC": 12, "RandomForest": 6, "GradientBoosting": 6, "SoftmaxBoosting": 6}
MOST_DEEP = {"LogisticRegression": 40, "LinearSVC": 45, "RandomForest": 18, "GradientBoosting": 18, "SoftmaxBoosting": 18}


def settings(ordinal: int, axes: list[list]) -> list:
    """The values of a place in the product of the axes, the last of which turns fastest: the place's digits."""
    out = []
    for values in reversed(axes):
        ordinal, k = divmod(ordinal, len(values))
        out.append(values[k])
    return out[::-1]


def stride(n: int, seed: int) -> tuple[int, int]:
    """(a, b) such that i -> (a * i + b) % n goes over 0 .. n - 1 without repeats: a has no divisor in common with n. Both come from the seed."""
    digest = hashlib.md5(str(seed).encode()).hexdigest()
    a = int(digest[:12], 16) % n
    while math.gcd(a, n) != 1:
        a += 1
    return a % n or 1, int(digest[12:24], 16) % n


def picked(n: int, most: int, seed: int | None) -> list[int]:
    """Places of a product of n to try, in order: the first ones, or with a seed a sample; no more work than is picked."""
    if seed is None or n <= most:
        return list(range(min(n, most)))
    a, b = stride(n, seed)
    return sorted((a * i + b) % n for i in range(most))


def candidates(model: str, grid: dict[str, list], texts: dict[str, list], deep: bool = False, seed: int = 42) -> list[dict]:
    """Settings to try of the product of both grids, which isn't built: its first ones, or in the deep search a sample of fixed order."""
    axes = [*grid.values(), *texts.values()]
    n = math.prod(len(v) for v in axes)
    return [dict(zip([*grid, *texts], settings(k, axes), strict=True)) for k in picked(n, (MOST_DEEP if deep else MOST)[model], seed if deep else None)]


def weighted(train: DataFrame) -> DataFrame:
    """Rows weighted so that all labels count alike."""
    n = train.groupBy("y_true").agg(F.count("*").alias("__n"))
    total, labels = n.agg(F.sum("__n"), F.count("*")).first()
    return train.join(F.broadcast(n), "y_true").withColumn("weight", F.lit(float(total)) / (labels * F.col("__n"))).drop("__n")


#: Settings of the features with what holds where they aren't given; all others are the model's.
TEXT = {"analyzer": "word", "ngram_range": (1, 1), "min_df": 2, "max_df": 0.95, "max_features": 30000, "sublinear_tf": True}


def estimator(model: str, **p):
    if model == "LogisticRegression":
        return LogisticRegression(weightCol="weight", maxIter=p.get("max_iter", 50), tol=p.get("tol", 1e-6), regParam=1.0 / p.get("C", 1.0) / 100)
    if model == "LinearSVC":
        return OneVsRest(classifier=LinearSVC(maxIter=p.get("max_iter", 50), tol=p.get("tol", 1e-6), regParam=1.0 / p.get("C", 1.0) / 100), weightCol="weight")
    if model == "RandomForest":
        return RandomForestClassifier(weightCol="weight", numTrees=p.get("n_estimators", 50), maxDepth=p.get("max_depth", 8), seed=42)
    return GBTClassifier(weightCol="weight", maxIter=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 4), stepSize=p.get("learning_rate", 0.1), seed=42)


@dataclass
class Classifier:
    """A vocabulary, the labels in order, and a fitted model for all labels, or boosted trees, one model for each label."""

    texts: Vectorizer
    labels: list[str]
    models: list
    each: bool = False
    #: Iterations after which the solver was stopped without having converged; 0 if it has.
    stopped: int = 0

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with features, the label number ``prediction``, and ``scores``, one for each label, where the model has scores."""
        return self.scored(self.texts.transform(rows))

    def scored(self, rows: DataFrame) -> DataFrame:
        """transform() of rows that have their features."""
        columns = [c for c in rows.columns if c != "features"]
        if isinstance(self.models[0], boosting.Boosted):
            return boosting.transform(self.models[0], rows, *columns).withColumn("prediction", F.col("prediction").cast("double"))
        if self.each:  # the label whose own model is surest
            for k, m in enumerate(self.models):
                rows = m.setFeaturesCol("features").setPredictionCol("__p").setProbabilityCol("__of").setRawPredictionCol("__raw").transform(rows)
                rows = rows.withColumn(f"__score{k}", vector_to_array("__of")[1]).drop("__p", "__of", "__raw")
            own = [f"__score{k}" for k in range(len(self.models))]
            rows = rows.withColumn("scores", F.array(*own)).drop(*own)
            return rows.withColumn("prediction", (F.array_position("scores", F.array_max("scores")) - 1).cast("double"))
        rows = self.models[0].transform(rows)
        score = "probability" if "probability" in rows.columns else "rawPrediction"
        return rows.withColumn("scores", vector_to_array(score)) if score in rows.columns else rows


def stopped_at(fitted, most: int) -> int:
    """most, if a linear model's solver has used up so many iterations (its training summary tells); else 0."""
    own = fitted.models if hasattr(fitted, "models") else [fitted]
    told = [m.summary() if callable(m.summary) else m.summary for m in own if m.hasSummary]
    return most if any(x.totalIterations >= most for x in told) else 0


class Features:
    """What candidates on the same rows have in common: vocabularies of the (weighted) training rows, and tables of both splits with features. Each is made once, when it is first asked for."""

    def __init__(self, train: DataFrame, val: DataFrame | None = None):
        self.train, self.val, self.index = train, val, None
        self.found: dict[str, Vectorizer] = {}
        self.tables: dict[tuple, DataFrame] = {}

    def texts(self, p: dict) -> Vectorizer:
        """The vectorizer of the text settings among p. Fewer features or other counts of the same grams are no new scan."""
        own = {k: p.get(k, v) for k, v in TEXT.items()}
        key = json.dumps(own)
        if key not in self.found:
            grams = json.dumps({k: v for k, v in own.items() if k not in ("max_features", "sublinear_tf")})
            wide, most = self.found.get(grams), own["max_features"]
            if wide is None or wide.most < most:
                wide = self.found[grams] = Vectorizer(self.train, "text", **own)
            self.found[key] = wide.narrowed(most, own["sublinear_tf"])
        return self.found[key]

    def _table(self, texts: Vectorizer, rows: DataFrame, name: str) -> DataFrame:
        at = (texts, name)
        if at not in self.tables:
            self.tables[at] = stored(texts.transform(rows).drop("text"), name)
        return self.tables[at]

    def labelled(self, rows: DataFrame) -> DataFrame:
        if self.index is None:
            self.index = StringIndexer(inputCol="y_true", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(self.train)
        return self.index.transform(rows)

    def taught(self, texts: Vectorizer) -> DataFrame:
        """The training rows with features and label."""
        return self.labelled(self._table(texts, self.train, "taught"))

    def held(self, texts: Vectorizer) -> DataFrame:
        """The validation rows with features."""
        return self._table(texts, self.val, "held")


def train_one(model: str, train: DataFrame, val: DataFrame | None, p: dict, features: Features | None = None) -> Classifier:
    """The features and the model, fitted to train. Boosted trees stop early on val, if it is given: once the loss on it
    falls by less than ``tolerance`` (0.01) from one tree to the next. features: those of train and val, to share them with other fits."""
    features = features or Features(train, val)
    own = {k: v for k, v in p.items() if k not in TEXT}
    how = None if model == "SoftmaxBoosting" else estimator(model, **own)
    if how is not None:
        how.write()  # hands the settings to Spark, which refuses wrong ones here, before texts are read for them
    texts = features.texts(p)
    rows = features.taught(texts).withColumn("held", F.lit(False))
    if model.endswith("Boosting") and val is not None:
        weights = F.broadcast(train.select("y_true", "weight").distinct())
        rows = rows.unionByName(features.labelled(features.held(texts)).join(weights, "y_true").withColumn("held", F.lit(True)), allowMissingColumns=True)
    labels = features.index.labels
    if model == "SoftmaxBoosting":
        names = {"n_estimators": "rounds", "max_depth": "depth", "learning_rate": "rate"}
        return Classifier(texts, labels, [boosting.fit(rows, len(labels), **{names.get(k, k): v for k, v in own.items()})])
    if model != "GradientBoosting":
        fitted = how.fit(rows)
        return Classifier(texts, labels, [fitted], stopped=0 if model == "RandomForest" else stopped_at(fitted, p.get("max_iter", 50)))
    if val is not None:
        how.setValidationIndicatorCol("held").set(how.validationTol, p.get("tolerance", 0.01))
    models = [how.fit(rows.withColumn("label", (F.col("label") == k).cast("double"))) for k in range(len(labels))]
    return Classifier(texts, labels, models, each=True)


def settled(model: str, train: DataFrame, val: DataFrame | None, p: dict, features: Features | None = None) -> tuple[Classifier, str]:
    """(classifier, note). A linear model whose solver hasn't converged is fitted once more, with four times the iterations and a looser tolerance; the note says so."""
    features = features or Features(train, val)
    first = train_one(model, train, val, p, features)
    if not first.stopped:
        return first, ""
    second = train_one(model, train, val, p | {"max_iter": 4 * first.stopped, "tol": 1e-4}, features)
    return second, f"not converged after {first.stopped} iterations; fitted again with {4 * first.stopped}: {'not converged' if second.stopped else 'converged'}"


def fit(model: str, train: DataFrame, val: DataFrame | None = None, features: Features | None = None, **p) -> tuple[Classifier, str]:
    """(classifier, note). A fit that fails is tried once more with plainer features and more iterations, one that doesn't converge with another solver setting. features: those of weighted(train) and val, if fits share them."""
    features = features or Features(weighted(train), val)
    try:
        return settled(model, features.train, val, p, features)
    except FAILURES as e:
        plain = p | {"min_df": 1, "max_df": 1.0, "ngram_range": (1, 1), "max_iter": 2 * p.get("max_iter", 50)}
        return train_one(model, features.train, val, plain if model in ("LogisticRegression", "LinearSVC") else {k: v for k, v in plain.items() if k != "max_iter"}, features), f"fallback after {type(e).__name__}"


def repairs(finals: DataFrame, trials: DataFrame) -> DataFrame:
    """For each final experiment that failed, the best successful trial of its scenario and model, to fit it anew."""
    best = best_in_group(trials.where("status = 'success'"), ["scenario", "model_name"], *evaluation.trial_order())
    failed = finals.where("status <> 'success'").select("scenario", "model_name").distinct()
    return failed.join(best, ["scenario", "model_name"])


def predict(model: Classifier, rows: DataFrame, top: int = 3) -> DataFrame:
    """Rows with y_pred, confidence and the best labels with their scores."""
    return named(model, model.transform(rows), rows.columns, top)


def measured(model: Classifier, features: Features, labels: list[str]) -> Row:
    """The metrics of a model on the validation rows, whose features are there."""
    rows = features.held(model.texts)
    return evaluation.overall(named(model, model.scored(rows), ["y_true"]), labels).first()


def named(model: Classifier, out: DataFrame, keep: list[str], top: int = 3) -> DataFrame:
    """The kept columns of scored rows, y_pred, confidence and the best labels."""
    one = F.array(F.struct(F.lit(1.0).alias("score"), (-F.col("prediction")).cast("int").alias("k")))
    scored = F.transform("scores", lambda x, i: F.struct(x.alias("score"), (-i).alias("k"))) if "scores" in out.columns else one
    best = F.slice(F.sort_array(scored, asc=False), 1, top)
    table = F.array(*[F.lit(n) for n in model.labels])
    out = out.withColumn("top", F.transform(best, lambda b: F.struct(F.get(table, -b["k"]).alias("label"), b["score"].alias("score"))))
    return out.select(*keep, F.get(table, F.col("prediction").cast("int")).alias("y_pred"), F.get("top", F.lit(0))["score"].alias("confidence"), "top")


def trials(train: DataFrame, val: DataFrame, settings: dict[str, list[dict]], labels: list[str]) -> DataFrame:
    """One row for each candidate: its metrics, or its error. Fits run one by one; each is distributed."""
    rows, features = [], Features(weighted(train), val)
    for model, tries in settings.items():
        for k, p in enumerate(tries):
            began = time.time()
            try:
                fitted, note = settled(model, features.train, val, p, features)
                m = measured(fitted, features, labels)
                rows.append((f"{model}-{k}", model, str(p), float(m.macro_f1), float(m.weighted_f1), float(m.accuracy), time.time() - began, "success", note))
            except FAILURES as e:  # a failed candidate is a row, as a successful one is
                rows.append((f"{model}-{k}", model, str(p), None, None, None, time.time() - began, f"failed: {type(e).__name__}", ""))
    schema = "trial_id string, model_name string, params string, macro_f1_val double, weighted_f1_val double, accuracy_val double, train_time_sec double, status string, note string"
    return train.sparkSession.createDataFrame(rows, schema)
