"""Classifier evaluation, trial ranking and error analysis over the fixture's predictions and trials."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import evaluation as E
from ..operators import learning as L
from ..operators.ranges import scratch
from ..operators.ranking import band_best, best_in_group
from ..sources import sinks
from ..functions import text as T
from .captions import _D, _GROUPS, _SLANG, _WORDS, GROUPS, SLANG, docs
from .fixture import PREDICTIONS, TRIALS, predictions, table, trials
from .catalog import query

LABELS = [f"T{k:02d}" for k in range(1, 18)]
_L = "l AS (SELECT unnest(" + str(LABELS) + ") AS label)"
_CLASS = f"""{PREDICTIONS}, {_L}, q AS (SELECT label, (SELECT count(*) FROM p WHERE y_true = label AND y_pred = label) AS tp, (SELECT count(*) FROM p WHERE y_pred = label) AS np, (SELECT count(*) FROM p WHERE y_true = label) AS nt FROM l),
c AS (SELECT *, coalesce(tp / nullif(np, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(nt, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(np + nt, 0), 0)::DOUBLE AS f1 FROM q)"""


@query(f"WITH {_CLASS} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, nt AS support FROM c")
def a25_class_report(spark, sf):
    return E.per_class(predictions(spark, sf), LABELS).select("label", *[rounded(x).alias(x) for x in ("precision", "recall", "f1")], "support")


_M = ["precision", "recall", "f1"]


@query(f"WITH {_CLASS} SELECT sum(nt)::BIGINT AS n, round(sum(tp) / sum(nt), 6) AS accuracy, {', '.join(f'round(avg({m}), 6) AS macro_{m}' for m in _M)}, {', '.join(f'round(sum({m} * nt) / sum(nt), 6) AS weighted_{m}' for m in _M)}, round(sum(tp) / sum(np), 6) AS micro_f1 FROM c")
def a24_overall_metrics(spark, sf):
    o = E.overall(predictions(spark, sf), LABELS)
    return o.select("n", rounded("accuracy").alias("accuracy"), *[rounded(f"{a}_{m}").alias(f"{a}_{m}") for a in ("macro", "weighted") for m in _M], rounded("micro_f1").alias("micro_f1"))


@query(f"WITH {PREDICTIONS}, {_L} SELECT label AS y_true, {', '.join(f'(SELECT count(*) FROM p WHERE y_true = label AND y_pred = {chr(39)}{x}{chr(39)}) AS {x}' for x in LABELS)} FROM l")
def a26_confusion(spark, sf):
    return E.confusion(predictions(spark, sf), LABELS)


@query(f"WITH {PREDICTIONS}, {_L} SELECT label AS y_true, {', '.join(f'round(coalesce((SELECT count(*) FROM p WHERE y_true = label AND y_pred = {chr(39)}{x}{chr(39)}) / nullif((SELECT count(*) FROM p WHERE y_true = label), 0), 0)::DOUBLE, 6) AS {x}' for x in LABELS)} FROM l")
def a26_confusion_normalised(spark, sf):
    c = E.confusion(predictions(spark, sf), LABELS, True)
    return c.select("y_true", *[rounded(x).alias(x) for x in LABELS])


@query(f"WITH {PREDICTIONS} SELECT y_true, y_pred, count(*) AS n FROM p WHERE y_true <> y_pred GROUP BY ALL ORDER BY n DESC, y_true, y_pred LIMIT 10")
def a27_confused_pairs(spark, sf):
    return E.confused_pairs(predictions(spark, sf), 10)


@query(f"WITH {PREDICTIONS} SELECT split, model_name, count(*) AS n, count(*) FILTER (WHERE y_true <> y_pred) AS n_wrong, round(avg((y_true <> y_pred)::INT), 6) AS error_rate FROM p GROUP BY ALL")
def a19_error_rates(spark, sf):
    return E.error_rate(predictions(spark, sf), ["split", "model_name"]).withColumn("error_rate", rounded("error_rate"))


@query(f"WITH {PREDICTIONS}, g AS (SELECT *, unnest(CASE WHEN record_id % 2 = 0 THEN ['even', 'all'] ELSE ['all'] END) AS word_group FROM p WHERE y_true <> y_pred) SELECT word_group, y_true, y_pred, count(*) AS n FROM g GROUP BY ALL")
def a21_group_confusions(spark, sf):
    g = F.explode(F.when(F.col("record_id") % 2 == 0, F.array(F.lit("even"), F.lit("all"))).otherwise(F.array(F.lit("all"))))
    return predictions(spark, sf).where("y_true <> y_pred").withColumn("word_group", g).groupBy("word_group", "y_true", "y_pred").agg(F.count("*").alias("n"))


@query(f"""WITH {PREDICTIONS}, {_D}, g AS (SELECT y_true, y_pred, unnest(CASE WHEN len({_GROUPS}) > 0 THEN {_GROUPS} ELSE ['none'] END) AS word_group FROM p LEFT JOIN d ON d.record_id = p.record_id WHERE y_true <> y_pred)
SELECT word_group, y_true, y_pred, count(*) AS n FROM g GROUP BY ALL""")
def a21_keyword_confusions(spark, sf):
    """Confusions of wrong rows by the keyword groups that their texts have, of which there may be several."""
    wrong = predictions(spark, sf).where("y_true <> y_pred").select("record_id", "y_true", "y_pred")
    met = wrong.join(docs(spark, sf).select("record_id", T.groups_in("caption", GROUPS).alias("g")), "record_id", "left")
    groups = F.when(F.size("g") > 0, F.col("g")).otherwise(F.array(F.lit("none")))
    return met.withColumn("word_group", F.explode(groups)).groupBy("word_group", "y_true", "y_pred").agg(F.count("*").alias("n"))


@query(f"""WITH {PREDICTIONS}, {_D} SELECT y_true = y_pred AS correct, count(*) AS n, round(avg(len({_SLANG}) / nullif(len({_WORDS}), 0)::DOUBLE), 6) AS density FROM d LEFT JOIN p ON d.record_id = p.record_id GROUP BY 1""")
def a20_slang_density(spark, sf):
    """Mean share of slang terms among a text's words by whether its prediction is right; texts without a prediction are a group, texts without words don't count."""
    d = docs(spark, sf).select("record_id", F.size(T.terms_in("caption", SLANG)).alias("slang"), T.word_count("caption").alias("words"))
    met = d.join(predictions(spark, sf).select("record_id", (F.col("y_true") == F.col("y_pred")).alias("correct")), "record_id", "left")
    return met.groupBy("correct").agg(F.count("*").alias("n"), rounded(F.avg(F.col("slang") / F.nullif(F.col("words"), F.lit(0)))).alias("density"))


@query(f"""WITH {_CLASS}, low AS (SELECT label FROM c WHERE nt > 0 ORDER BY round(c.f1, 9), label LIMIT 5)
SELECT label, record_id, y_pred FROM low JOIN p ON y_true = label WHERE y_true <> y_pred QUALIFY row_number() OVER (PARTITION BY label ORDER BY record_id) <= 3""")
def a42_wrong_examples(spark, sf):
    """The first three wrong rows of each of the five weakest labels that occur."""
    p = predictions(spark, sf)
    low = E.per_class(p, LABELS).where("support > 0").orderBy(F.round("f1", 9), "label").limit(5).select("label")
    wrong = p.where("y_true <> y_pred").join(F.broadcast(low), F.col("y_true") == F.col("label"))  # five rows
    rank = F.row_number().over(Window.partitionBy("label").orderBy("record_id"))  # each task keeps three of a label
    return wrong.withColumn("n", rank).where("n <= 3").select("label", "record_id", "y_pred")


@query(f"WITH {PREDICTIONS} SELECT scenario, model_name, count(*) AS n, round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM p GROUP BY ALL ORDER BY round(avg((y_true = y_pred)::INT), 9), scenario, model_name LIMIT 5")
def a42_weakest_models(spark, sf):
    right = F.avg((F.col("y_true") == F.col("y_pred")).cast("int"))
    g = predictions(spark, sf).groupBy("scenario", "model_name").agg(F.count("*").alias("n"), right.alias("a"))
    return g.orderBy(F.round("a", 9), "scenario", "model_name").limit(5).select("scenario", "model_name", "n", rounded("a").alias("accuracy"))


@query(f"WITH {_CLASS} SELECT label, round(f1, 6) AS f1 FROM c ORDER BY round(c.f1, 9), label LIMIT 5")
def a42_lowest_f1(spark, sf):
    return E.per_class(predictions(spark, sf), LABELS).orderBy(F.round("f1", 9), "label").limit(5).select("label", rounded("f1").alias("f1"))


@query(f"WITH {PREDICTIONS}, v AS (SELECT record_id // 4 AS g, y_pred, count(*) AS n FROM p GROUP BY ALL) SELECT g, y_pred, n FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, y_pred) = 1")
def a31_majority_vote(spark, sf):
    v = predictions(spark, sf).groupBy(F.floor(F.col("record_id") / 4).alias("g"), "y_pred").agg(F.count("*").alias("n"))
    return best_in_group(v, ["g"], F.col("n").desc(), F.col("y_pred"))


@query("SELECT vec_id, [x.k FOR x IN list_slice(list_reverse_sort([{'v': embedding[i], 'k': -i} FOR i IN range(1, len(embedding) + 1)]), 1, 3)]::INT[]::VARCHAR AS top3 FROM embeddings")
def w7_top3_labels(spark, sf):
    """The three best of a row's scores, ties to the first."""
    scored = F.transform("embedding", lambda x, i: F.struct(x.alias("v"), (-i - 1).alias("k")))
    best = F.slice(F.sort_array(scored, asc=False), 1, 3)
    return table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(F.transform(best, lambda x: x["k"].cast("string")), ", "), F.lit("]")).alias("top3"))


@query(f"WITH {PREDICTIONS} SELECT record_id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM p")
def m18_confidence_band(spark, sf):
    return predictions(spark, sf).select("record_id", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low").alias("band"))


@query(f"WITH {PREDICTIONS}, n AS (SELECT unnest(['T01', 'T02', 'T03']) AS id, unnest(['Politics', 'World', 'Economy']) AS name) SELECT record_id, coalesce(a.name, y_true) AS true_name, coalesce(b.name, y_pred) AS pred_name, y_true = y_pred AS correct FROM p LEFT JOIN n a ON a.id = y_true LEFT JOIN n b ON b.id = y_pred")
def x14_prediction_names(spark, sf):
    names = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for x in ("T01", "Politics", "T02", "World", "T03", "Economy")])).alias("id", "name"))
    a, b = (F.broadcast(names.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"))) for s in "ab")
    p = predictions(spark, sf)
    p = p.join(a, p.y_true == F.col("a_id"), "left").join(b, p.y_pred == F.col("b_id"), "left")
    return p.select("record_id", F.coalesce("a_name", "y_true").alias("true_name"), F.coalesce("b_name", "y_pred").alias("pred_name"), (F.col("y_true") == F.col("y_pred")).alias("correct"))


@query(f"WITH {PREDICTIONS} SELECT y_true, dense_rank() OVER (ORDER BY y_true) - 1 AS code FROM (SELECT DISTINCT y_true FROM p)")
def l1_label_encode(spark, sf):
    found = predictions(spark, sf).select("y_true").distinct()
    return found.select("y_true", (F.dense_rank().over(Window.orderBy("y_true")) - 1).cast("bigint").alias("code"))


# --- trials ----------------------------------------------------------------------------------------------------------

_ORDER = "macro_f1_val DESC NULLS LAST, weighted_f1_val DESC NULLS LAST, accuracy_val DESC NULLS LAST, train_time_sec NULLS LAST, trial_id"


@query(f"WITH {TRIALS}, k AS (SELECT trial_id, row_number() OVER (ORDER BY {_ORDER})::INT AS rank_global, row_number() OVER (PARTITION BY scenario, model_name ORDER BY {_ORDER})::INT AS rank_within_scenario_model FROM t) SELECT *, rank_within_scenario_model = 1 AS is_best_for_scenario_model, rank_global = 1 AS is_best_overall FROM k")
def w4_k3_rank_trials(spark, sf):
    return E.rank_trials(trials(spark, sf)).select("trial_id", "rank_global", "rank_within_scenario_model", "is_best_for_scenario_model", "is_best_overall")


_SIMPLE = "max_features, ngram_max, CASE analyzer WHEN 'word' THEN 0 ELSE 1 END, train_time_sec"


@query(f"WITH {TRIALS}, s AS (SELECT *, max(macro_f1_val) OVER (PARTITION BY scenario, model_name) AS best FROM t WHERE status = 'success') SELECT scenario, model_name, trial_id FROM s WHERE macro_f1_val >= best - 0.003 QUALIFY row_number() OVER (PARTITION BY scenario, model_name ORDER BY weighted_f1_val DESC, accuracy_val DESC, {_SIMPLE}, macro_f1_val DESC, trial_id) = 1")
def w5_tolerance_band(spark, sf):
    simple = [F.col("max_features"), F.col("ngram_max"), F.when(F.col("analyzer") == "word", 0).otherwise(1), F.col("train_time_sec")]
    order = [F.col("weighted_f1_val").desc(), F.col("accuracy_val").desc(), *simple, F.col("macro_f1_val").desc(), F.col("trial_id")]
    return band_best(trials(spark, sf).where("status = 'success'"), ["scenario", "model_name"], "macro_f1_val", 0.003, *order).select("scenario", "model_name", "trial_id")


@query(f"WITH {TRIALS} SELECT model_name, trial_id AS best_trial_id, round(macro_f1_val, 6) AS best_macro_f1 FROM t WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY {_ORDER}) = 1")
def w6_f19_best_rows(spark, sf):
    best = best_in_group(trials(spark, sf).where("status = 'success'"), ["model_name"], *E.trial_order())
    return best.select("model_name", F.col("trial_id").alias("best_trial_id"), rounded("macro_f1_val").alias("best_macro_f1"))


_LONG = "SELECT model_name, 'c' AS param, c AS value, macro_f1_val, train_time_sec FROM t WHERE status = 'success' UNION ALL SELECT model_name, 'n_estimators', n_estimators, macro_f1_val, train_time_sec FROM t WHERE status = 'success'"


def long_params(spark, sf):
    t = trials(spark, sf).where("status = 'success'")
    return t.unpivot(["model_name", "macro_f1_val", "train_time_sec"], ["c", "n_estimators"], "param", "value").where("value is not null")


@query(f"WITH {TRIALS}, u AS ({_LONG}) SELECT model_name, param, value, count(*) AS n, round(avg(macro_f1_val), 6) AS mean_f1, round(max(macro_f1_val), 6) AS max_f1, round(stddev_pop(macro_f1_val), 6) AS std_f1, round(avg(train_time_sec), 6) AS mean_time FROM u WHERE value IS NOT NULL GROUP BY ALL")
def a22_a23_param_effects(spark, sf):
    return long_params(spark, sf).groupBy("model_name", "param", "value").agg(F.count("*").alias("n"), rounded(F.avg("macro_f1_val")).alias("mean_f1"), rounded(F.max("macro_f1_val")).alias("max_f1"), rounded(F.stddev_pop("macro_f1_val")).alias("std_f1"), rounded(F.avg("train_time_sec")).alias("mean_time"))


@query(f"WITH {TRIALS}, u AS ({_LONG}) SELECT param, value, round(f, 6) AS best_f1 FROM (SELECT param, value, max(macro_f1_val) AS f FROM u WHERE value IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY param ORDER BY f DESC, value) = 1")
def a41_best_value(spark, sf):
    best = long_params(spark, sf).groupBy("param", "value").agg(F.max("macro_f1_val").alias("f"))
    return best_in_group(best, ["param"], F.col("f").desc(), F.col("value")).select("param", "value", rounded("f").alias("best_f1"))


@query(f"WITH {TRIALS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status <> 'success') AS failed, count(*) FILTER (WHERE macro_f1_val IS NULL) AS no_score, round(avg(macro_f1_val) FILTER (WHERE model_name IN ('M0', 'M1')), 6) AS linear, round(avg(macro_f1_val) FILTER (WHERE model_name IN ('M2', 'M3')), 6) AS tree FROM t")
def a40_trial_diagnostics(spark, sf):
    ok = F.col("status") == "success"
    part = lambda *m: rounded(F.avg(F.when(F.col("model_name").isin(*m), F.col("macro_f1_val"))))
    return trials(spark, sf).agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.count_if(F.col("macro_f1_val").isNull()).alias("no_score"), part("M0", "M1").alias("linear"), part("M2", "M3").alias("tree"))


@query(f"""WITH {TRIALS}, s AS (SELECT * FROM t WHERE status = 'success'), b AS (SELECT * FROM s WHERE macro_f1_val >= (SELECT max(macro_f1_val) FROM s) - 0.003 ORDER BY weighted_f1_val DESC, accuracy_val DESC, {_SIMPLE}, macro_f1_val DESC, trial_id LIMIT 1)
SELECT count(*) AS total, count(*) FILTER (WHERE t.status = 'success') AS success, count(*) FILTER (WHERE t.status <> 'success') AS failed, count(*) FILTER (WHERE t.trial_id % 19 <> 0 AND t.trial_id % 13 = 0) AS fallback, count(t.macro_f1_val) AS scored,
any_value(b.trial_id) AS best_trial_id, any_value(b.scenario) AS best_scenario, any_value(b.model_name) AS best_model, round(any_value(b.macro_f1_val), 6) AS best_macro_f1 FROM t, b""")
def a40_diagnostics(spark, sf):
    """The whole report of a search: counts, fallbacks, and the best within the tolerance. Whether a trial fell back isn't known of all."""
    fell = F.when(F.col("trial_id") % 19 != 0, F.col("trial_id") % 13 == 0)
    simple = [F.col("max_features"), F.col("ngram_max"), F.when(F.col("analyzer") == "word", 0).otherwise(1), F.col("train_time_sec")]
    return E.diagnostics(trials(spark, sf), fell, simple).withColumn("best_macro_f1", rounded("best_macro_f1"))


@query(f"WITH {TRIALS} SELECT trial_id, round(weighted_f1_val - accuracy_val, 6) AS gap, abs(weighted_f1_val - accuracy_val) > 0.04 AS flagged FROM t")
def a36_gap(spark, sf):
    gap = F.col("weighted_f1_val") - F.col("accuracy_val")
    return trials(spark, sf).select("trial_id", rounded(gap).alias("gap"), (F.abs(gap) > 0.04).alias("flagged"))


@query(f"""WITH {TRIALS}, b AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) = 1 AS o, row_number() OVER (PARTITION BY model_name ORDER BY {_ORDER}) = 1 AS m, row_number() OVER (ORDER BY accuracy_val DESC, trial_id) = 1 AS a FROM t)
SELECT trial_id, concat_ws('; ', CASE WHEN o THEN 'best overall' END, CASE WHEN m THEN 'best of ' || model_name END, CASE WHEN a THEN 'best accuracy' END) AS notes FROM b WHERE o OR m OR a""")
def a39_selection_notes(spark, sf):
    last = float("inf")
    by_scores = F.struct(*[F.coalesce(-F.col(c), F.lit(last)) for c in ("macro_f1_val", "weighted_f1_val", "accuracy_val")], F.coalesce("train_time_sec", F.lit(last)), "trial_id")
    by_accuracy = F.struct(F.coalesce(-F.col("accuracy_val"), F.lit(last)), "trial_id")
    t = trials(spark, sf)
    found = t.agg(F.min_by("trial_id", by_scores).alias("trial_id")).select("trial_id", F.lit(1).alias("k"), F.lit("best overall").alias("note"))
    found = found.unionByName(t.groupBy("model_name").agg(F.min_by("trial_id", by_scores).alias("trial_id")).select("trial_id", F.lit(2).alias("k"), F.concat(F.lit("best of "), "model_name").alias("note")))
    found = found.unionByName(t.agg(F.min_by("trial_id", by_accuracy).alias("trial_id")).select("trial_id", F.lit(3).alias("k"), F.lit("best accuracy").alias("note")))
    notes = F.transform(F.sort_array(F.collect_list(F.struct("k", "note"))), lambda x: x["note"])  # a row for each model, and two
    return found.groupBy("trial_id").agg(F.array_join(notes, "; ").alias("notes"))


@query(f"WITH {TRIALS}, f AS (SELECT scenario, model_name, macro_f1_val AS x FROM t WHERE trial_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY scenario, model_name ORDER BY trial_id) = 1), d AS (SELECT scenario, model_name, macro_f1_val AS y FROM t WHERE trial_id % 3 = 1 QUALIFY row_number() OVER (PARTITION BY scenario, model_name ORDER BY trial_id) = 1) SELECT f.scenario, f.model_name, round(y - x, 6) AS gain FROM f JOIN d ON f.scenario = d.scenario AND f.model_name = d.model_name")
def j8_fast_vs_deep(spark, sf):
    keys = ["scenario", "model_name"]
    t = trials(spark, sf)
    fast, deep = (best_in_group(t.where(F.col("trial_id") % 3 == k), keys, F.col("trial_id")).select(*keys, F.col("macro_f1_val").alias(n)) for k, n in ((0, "x"), (1, "y")))
    return fast.join(deep, keys).select(*keys, rounded(F.col("y") - F.col("x")).alias("gain"))


@query(f"WITH {TRIALS}, b AS (SELECT scenario, model_name, max(c) AS c FROM t WHERE macro_f1_val > 0.99 GROUP BY ALL), k AS (SELECT scenario, model_name, max(c) AS c FROM t GROUP BY ALL) SELECT k.scenario, k.model_name, coalesce(b.c, k.c) AS c FROM k LEFT JOIN b ON b.scenario = k.scenario AND b.model_name = k.model_name")
def j9_lookup_fallback(spark, sf):
    """Settings of the best trials, and of all trials where a pair has no such trial."""
    keys = ["scenario", "model_name"]
    t = trials(spark, sf)
    ranked, best = t.groupBy(*keys).agg(F.max("c").alias("k")), t.where("macro_f1_val > 0.99").groupBy(*keys).agg(F.max("c").alias("b"))
    return ranked.join(best, keys, "left").select(*keys, F.coalesce("b", "k").alias("c"))


@query(f"WITH {TRIALS} SELECT trial_id, concat_ws(', ', 'max_features=' || max_features, 'ngram=1-' || ngram_max, 'C=' || printf('%.2f', c)) AS params FROM t")
def x11_param_summary(spark, sf):
    return trials(spark, sf).select("trial_id", F.concat_ws(", ", F.format_string("max_features=%d", "max_features"), F.format_string("ngram=1-%d", "ngram_max"), F.when(F.col("c").isNotNull(), F.format_string("C=%.2f", "c"))).alias("params"))


@query(f"WITH {TRIALS} SELECT trial_id, macro_f1_val, weighted_f1_val, accuracy_val FROM t")
def x12_flatten(spark, sf):
    nested = trials(spark, sf).select("trial_id", F.struct(F.struct("macro_f1_val", "weighted_f1_val", "accuracy_val").alias("val")).alias("metrics"))
    return nested.select("trial_id", "metrics.val.*")


_KNOWN = {"val": {"accuracy": "accuracy_val", "macro_f1": "macro_f1_val", "weighted_f1": "weighted_f1_val"}, "test": {"accuracy": "CASE WHEN status = 'success' THEN trial_id % 83 / 83.0::DOUBLE END", "micro_recall": "CASE WHEN status = 'success' THEN trial_id % 71 / 71.0::DOUBLE END"}}


@query(f"""WITH {TRIALS} SELECT trial_id, scenario, model_name, status, '{{"analyzer":"' || analyzer || '","max_features":' || max_features || ',"ngram_range":[1,' || ngram_max || ']}}' AS tfidf_params_json, analyzer AS tfidf_analyzer, max_features AS tfidf_max_features,
'(1, ' || ngram_max || ')' AS tfidf_ngram_range, NULL::VARCHAR AS tfidf_min_df, '{{' || concat_ws(',', '"C":' || c, '"n_estimators":' || n_estimators) || '}}' AS model_params_json, c AS "C", n_estimators, NULL::VARCHAR AS max_depth,
{", ".join(f"{_KNOWN[s].get(m, 'NULL::DOUBLE')} AS {m}_{s}" for s in ("val", "test") for m in E.METRICS)} FROM t""")
def x12_flat_results(spark, sf):
    """Trials nested as a search gives them, settings and metrics of both splits inside, as flat rows again."""
    metric = lambda **m: F.map_filter(F.create_map(*[x for n, v in m.items() for x in (F.lit(n), v.cast("double"))]), lambda k, v: v.isNotNull())
    k = F.col("trial_id")
    nested = trials(spark, sf).select(
        "trial_id", "scenario", "model_name", "status", F.struct("analyzer", "max_features", F.array(F.lit(1).cast("bigint"), F.col("ngram_max")).alias("ngram_range")).alias("tfidf_params"), F.struct(F.col("c").alias("C"), "n_estimators").alias("model_params"),
        metric(accuracy=F.col("accuracy_val"), macro_f1=F.col("macro_f1_val"), weighted_f1=F.col("weighted_f1_val")).alias("metrics_val"),
        F.when(F.col("status") == "success", metric(accuracy=k % 83 / 83.0, micro_recall=k % 71 / 71.0)).alias("metrics_test"))
    return E.flat_results(nested, {"metrics_val": "val", "metrics_test": "test"}, {"tfidf_params": ("tfidf_", ["analyzer", "max_features", "ngram_range", "min_df"]), "model_params": ("", ["C", "n_estimators", "max_depth"])})


@query(f"WITH {TRIALS} SELECT trial_id, (macro_f1_val IS NOT NULL)::INT + 2 AS n_metrics, macro_f1_val AS macro_f1 FROM t")
def x13_nest(spark, sf):
    names = ["macro_f1_val", "weighted_f1_val", "accuracy_val"]
    m = F.map_filter(F.map_from_arrays(F.array(*[F.lit(x.removesuffix("_val")) for x in names]), F.array(*names)), lambda k, v: v.isNotNull())
    return trials(spark, sf).select("trial_id", m.alias("m")).select("trial_id", F.size("m").alias("n_metrics"), F.try_element_at("m", F.lit("macro_f1")).alias("macro_f1"))


_AXES = "a AS (SELECT list(DISTINCT p_size ORDER BY p_size) AS s, list(DISTINCT p_brand ORDER BY p_brand) AS b, list(DISTINCT p_type ORDER BY p_type) AS t FROM part), n AS (SELECT *, (len(s) * len(b) * len(t))::BIGINT AS n FROM a)"
_DIGEST = "md5('42')"
_PLACE = "s[k // (len(b) * len(t)) + 1] AS size, b[(k // len(t)) % len(b) + 1] AS brand, t[k % len(t) + 1] AS type"


@query(f"""WITH {_AXES}, d AS (SELECT *, ('0x' || substr({_DIGEST}, 1, 12))::BIGINT % n AS a0, ('0x' || substr({_DIGEST}, 13, 12))::BIGINT % n AS b0 FROM n),
m AS (SELECT *, (SELECT min(x) FROM (SELECT unnest(range(a0, a0 + 100)) AS x) WHERE gcd(x, n) = 1) % n AS a1 FROM d),
p AS (SELECT 'first' AS search, s, b, t, unnest(range(least(n, 12))) AS k FROM n UNION ALL
  SELECT 'sample', s, b, t, CASE WHEN n <= 40 THEN i ELSE ((CASE WHEN a1 = 0 THEN 1 ELSE a1 END) * i + b0) % n END FROM (SELECT *, unnest(range(least(n, 40))) AS i FROM m))
SELECT search, k::BIGINT AS ordinal, {_PLACE} FROM p""")
def x10_param_grid(spark, sf):
    """Settings of both searches over a grid whose axes are the values that parts have: the first ones, and a sample without repeats."""
    axes = table(spark, sf, "part").agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("p_size", "p_brand", "p_type")]).first()  # the axes of a grid
    grid, texts = {"size": axes.p_size, "brand": axes.p_brand}, {"type": axes.p_type}
    found = [(search, k, c) for search, deep in (("first", False), ("sample", True)) for k, c in zip(L.picked(math.prod(map(len, axes)), (L.MOST_DEEP if deep else L.MOST)["LogisticRegression"], 42 if deep else None), L.candidates("LogisticRegression", grid, texts, deep), strict=True)]
    return spark.createDataFrame([(search, k, c["size"], c["brand"], c["type"]) for search, k, c in found], "search string, ordinal bigint, size int, brand string, type string")


_CELL = lambda x: f"CASE WHEN bold AND {x} <> '' THEN '**' || {x} || '**' ELSE {x} END"


@query(f"""WITH {TRIALS}, x AS (SELECT trial_id, trial_id::VARCHAR AS c1, replace(scenario || '|' || model_name, '|', chr(92) || '|') AS c2, coalesce(printf('%.4f', macro_f1_val), '') AS c3, coalesce(printf('%.4f', accuracy_val), '') AS c4, coalesce(macro_f1_val >= 0.99, false) AS bold FROM t)
SELECT trial_id, '| ' || {_CELL("c1")} || ' | ' || {_CELL("c2")} || ' | ' || {_CELL("c3")} || ' | ' || {_CELL("c4")} || ' |' AS line FROM x""")
def s13_markdown(spark, sf):
    """The whole table as lines of Markdown, the best rows in bold: written by the sink and read again. A line's first cell is its trial."""
    rows = trials(spark, sf).select("trial_id", F.concat_ws("|", "scenario", "model_name").alias("experiment"), "macro_f1_val", "accuracy_val")
    path = scratch(spark, "markdown")
    sinks.to_markdown(rows, path, ["trial_id"], bold=F.coalesce(F.col("macro_f1_val") >= 0.99, F.lit(False)))
    lines = spark.read.text(f"{path}/1-rows")
    return lines.select(F.regexp_extract("value", r"^\| (?:\*\*)?(\d+)", 1).cast("bigint").alias("trial_id"), F.col("value").alias("line"))


@query(f"WITH {TRIALS}, b AS (SELECT * FROM t WHERE status = 'success') SELECT model_name, NULL AS scenario, 'best' AS \"group\", true AS recommended, max(macro_f1_val) AS f1 FROM b GROUP BY 1 UNION ALL SELECT model_name, scenario, 'scenario', false, max(macro_f1_val) FROM b GROUP BY ALL")
def s17_model_registry(spark, sf):
    t = trials(spark, sf).where("status = 'success'")
    best = t.groupBy("model_name").agg(F.max("macro_f1_val").alias("f1")).select("model_name", F.lit(None).cast("string").alias("scenario"), F.lit("best").alias("group"), F.lit(True).alias("recommended"), "f1")
    every = t.groupBy("model_name", "scenario").agg(F.max("macro_f1_val").alias("f1")).select("model_name", "scenario", F.lit("scenario").alias("group"), F.lit(False).alias("recommended"), "f1")
    return best.unionByName(every)
