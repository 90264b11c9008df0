"""Classifier evaluation from prediction tables: metrics over a fixed label set, confusion, error slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from .ranges import row_numbers


def label_grid(spark, labels: list[str], name: str = "label") -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias(name))


def class_counts(pred: DataFrame, labels: list[str], by: list[str] = ()) -> DataFrame:
    """by, label, tp, n_pred, n_true for every label of the fixed set, from one pass of pre-aggregated pairs."""
    pairs = pred.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    sides = pairs.select(*by, F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(True).alias("is_true")), F.struct(F.col("y_pred").alias("label"), F.lit(False).alias("is_true")))).alias("s"), "n", (F.col("y_true") == F.col("y_pred")).alias("ok"))
    counts = sides.groupBy(*by, F.col("s.label").alias("label")).agg(
        F.coalesce(F.sum(F.when(F.col("s.is_true") & F.col("ok"), F.col("n"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(~F.col("s.is_true"), F.col("n"))), F.lit(0)).alias("n_pred"), F.coalesce(F.sum(F.when(F.col("s.is_true"), F.col("n"))), F.lit(0)).alias("n_true"))
    every = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    grid = pred.select(*by).distinct().select(*by, every) if by else pred.sparkSession.range(1).select(every)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tp", "n_pred", "n_true")}
    return grid.join(counts, [*by, "label"], "left").withColumns(zero)


def or_zero(a, b) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def per_class(pred: DataFrame, labels: list[str], by: list[str] = ()) -> DataFrame:
    """by, label, precision, recall, f1, support; zero where undefined."""
    c = class_counts(pred, labels, by)
    return c.select(*by, "label", or_zero("tp", "n_pred").alias("precision"), or_zero("tp", "n_true").alias("recall"), or_zero(2 * F.col("tp"), F.col("n_pred") + F.col("n_true")).alias("f1"), F.col("n_true").alias("support"), "tp", "n_pred")


def overall(pred: DataFrame, labels: list[str], by: list[str] = ()) -> DataFrame:
    """accuracy, and macro, weighted and micro precision, recall and f1."""
    m = ["precision", "recall", "f1"]
    p = per_class(pred, labels, by)
    out = p.groupBy(*by).agg(
        F.sum("support").alias("n"), or_zero(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(x).alias(f"macro_{x}") for x in m], *[or_zero(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(f"weighted_{x}") for x in m],
        or_zero(F.sum("tp"), F.sum("n_pred")).alias("micro_precision"), or_zero(F.sum("tp"), F.sum("support")).alias("micro_recall"), or_zero(2 * F.sum("tp"), F.sum("n_pred") + F.sum("support")).alias("micro_f1"))
    return out


def confusion(pred: DataFrame, labels: list[str], normalised: bool = False) -> DataFrame:
    """y_true and one column for each label, over the whole label set; rows without support are zero."""
    wide = pred.groupBy("y_true").pivot("y_pred", labels).count()
    grid = label_grid(pred.sparkSession, labels, "y_true").join(wide, "y_true", "left")
    cells = {x: F.coalesce(x, F.lit(0)) for x in labels}
    total = reduce(lambda a, b: a + b, cells.values())
    return grid.select("y_true", *[(or_zero(v, total) if normalised else v).alias(x) for x, v in cells.items()])


def confused_pairs(pred: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    return pred.where("y_true <> y_pred").groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *by, "y_true", "y_pred").limit(k)


def error_rate(pred: DataFrame, by: list[str]) -> DataFrame:
    wrong = F.col("y_true") != F.col("y_pred")
    return pred.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(wrong).alias("n_wrong"), F.avg(wrong.cast("int")).alias("error_rate"))


# Order of trials: nulls last, faster first.
def trial_order() -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in ("macro_f1_val", "weighted_f1_val", "accuracy_val")] + [F.col("train_time_sec").asc_nulls_last(), F.col("trial_id")]


def rank_trials(trials: DataFrame) -> DataFrame:
    """Global rank (by ranges) and rank within (scenario, model), with flags of the best."""
    order = trial_order()
    out = row_numbers(trials, order, "rank_global").withColumn("rank_within_scenario_model", F.row_number().over(Window.partitionBy("scenario", "model_name").orderBy(*order)))
    return out.withColumns({"is_best_for_scenario_model": F.col("rank_within_scenario_model") == 1, "is_best_overall": F.col("rank_global") == 1})


def diagnostics(trials: DataFrame, fallback: Column, simple: list[Column], key: str = "trial_id", tolerance: float = 0.003) -> DataFrame:
    """One row: how many trials there are, succeeded, failed, fell back (null is no) and have a score, and the best of those that succeeded.

    The best is, within a tolerance of the greatest macro F1, that with the greatest weighted F1, then accuracy, then the simplest, by the given order of
    numbers, nulls last; further ties go to the greater macro F1 and the least key. Two aggregates, whatever the number of trials; without a score nothing is best.
    """
    score, ok, last = F.col("macro_f1_val"), F.col("status") == "success", float("inf")
    most = trials.where(ok).agg(F.max(score)).first()[0]
    near = ok & (score >= F.lit(most).cast("double") - tolerance)
    order = F.struct(*[F.coalesce(x.cast("double"), F.lit(last)).alias(f"k{i}") for i, x in enumerate([-F.col("weighted_f1_val"), -F.col("accuracy_val"), *simple, -score])], F.col(key))
    best = F.min_by(F.when(near, F.struct(F.col(key), "scenario", "model_name", score)), F.when(near, order))
    told = trials.agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.count_if(F.coalesce(fallback, F.lit(False))).alias("fallback"), F.count(score).alias("scored"), best.alias("b"))
    return told.select("total", "success", "failed", "fallback", "scored", F.col(f"b.{key}").alias(f"best_{key}"), F.col("b.scenario").alias("best_scenario"), F.col("b.model_name").alias("best_model"), F.col("b.macro_f1_val").alias("best_macro_f1"))


#: All metrics of a result.
METRICS = ["accuracy", *[f"{kind}_{m}" for kind in ("macro", "weighted", "micro") for m in ("precision", "recall", "f1")]]


def flat_results(results: DataFrame, metrics: dict[str, str], params: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Nested results as flat rows; columns that aren't named stay.

    metrics: columns that are maps of metrics, with the suffix of their ten columns; what a map lacks, or a null map, is null. params: columns that are structs of
    settings, with the prefix and names of the settings that become columns; a struct without the setting gives null, and a list becomes text, '(1, 2)'. The whole struct
    is kept as JSON in <column>_json, without settings that are null.
    """
    def setting(name, field):
        known = {f.name: f.dataType.typeName() for f in results.schema[name].dataType.fields}
        if field not in known:
            return F.lit(None).cast("string")
        value = F.col(f"`{name}`.`{field}`")
        return F.concat(F.lit("("), F.array_join(value, ", "), F.lit(")")) if known[field] == "array" else value

    out = [F.col(f"`{c}`") for c in results.columns if c not in metrics and c not in params]
    for name, (prefix, wanted) in params.items():
        out += [F.to_json(F.col(f"`{name}`")).alias(f"{name}_json"), *[setting(name, f).alias(f"{prefix}{f}") for f in wanted]]
    out += [F.try_element_at(F.col(f"`{name}`"), F.lit(m)).alias(f"{m}_{suffix}") for name, suffix in metrics.items() for m in METRICS]
    return results.select(*out)
