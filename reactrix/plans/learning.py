"""Model benchmark over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparing, ledger
from ..operators import learning as L
from ..operators.ranges import dealt, scratch
from .catalog import query
from .fixture import TRIALS, table, trials


def splits(spark, sf):
    d = dealt(table(spark, sf, "documents")).select(F.col("doc_id").alias("record_id"), "text", F.col("lang").alias("y_true"))
    part = F.pmod(F.crc32(F.col("record_id").cast("string")), F.lit(10))
    return d.where(part < 7), d.where(part == 7), d.where(part > 7)


@query()
def l2_l4_trials(spark, sf):
    """Candidates of all four model families, scored on the validation split."""
    train, val, _ = splits(spark, sf)
    words = {"max_features": [500], "ngram_range": [(1, 1), (1, 2)]}
    chars = {"max_features": [200], "analyzer": ["char_wb"], "ngram_range": [(2, 3)]}
    few = {"max_features": [100]}
    grids = {"LogisticRegression": ({"C": [1.0]}, words), "LinearSVC": ({"C": [1.0], "max_iter": [10]}, chars), "RandomForest": ({"n_estimators": [10]}, few), "GradientBoosting": ({"n_estimators": [3], "max_depth": [2]}, few)}
    tries = {model: L.candidates(model, grid, texts) for model, (grid, texts) in grids.items()}
    return L.trials(train, val, tries, ["de", "en", "es", "fr"]).select("trial_id", "model_name", "macro_f1_val", "status")


@query()
def l5_l6_l9_final_predictions(spark, sf):
    """The chosen setting refitted on train and validation, applied to the test split with its best labels."""
    train, val, test = splits(spark, sf)
    model, _ = L.fit("LogisticRegression", train.unionByName(val), C=1.0, max_features=500)
    return L.predict(model, test).select("record_id", "y_true", "y_pred", F.round("confidence", 4).alias("confidence"))


_ORDER = "macro_f1_val DESC NULLS LAST, weighted_f1_val DESC NULLS LAST, accuracy_val DESC NULLS LAST, train_time_sec NULLS LAST, trial_id"


@query(f"WITH {TRIALS} SELECT scenario, model_name, trial_id FROM t WHERE status = 'success' AND (scenario, model_name) IN (SELECT (scenario, model_name) FROM t WHERE status <> 'success') QUALIFY row_number() OVER (PARTITION BY scenario, model_name ORDER BY {_ORDER}) = 1")
def l7_repairs(spark, sf):
    """The settings with which failed final experiments are fitted anew."""
    t = trials(spark, sf)
    return L.repairs(t, t).select("scenario", "model_name", "trial_id")


LANGS = ["de", "en", "es", "fr"]


@query()
def l3_softmax_boosting(spark, sf):
    """Boosted trees for all labels at once, stopped early on the validation rows, applied to the test split."""
    train, val, test = splits(spark, sf)
    model, _ = L.fit("SoftmaxBoosting", train, val, n_estimators=6, max_depth=2, max_features=300)
    return L.predict(model, test).select("record_id", "y_true", "y_pred", F.round("confidence", 4).alias("confidence"))


@query()
def l4_l7_ledger(spark, sf):
    """A search that is cut short after its first trial and goes on, a final that fails, and its repair with the best trial's settings."""
    train, val, _ = splits(spark, sf)
    book, rows = ledger.Ledger(spark, scratch(spark, "ledger")), {"lang": (train, val)}
    tries = [("lang", "LogisticRegression", {"C": c, "max_features": 200, "max_iter": 10}) for c in (1.0, 0.1, -1.0)]
    made = {}
    ledger.run(book, rows, tries, LANGS, most=1, made=made)
    ledger.run(book, rows, tries, LANGS, made=made)
    ledger.run(book, rows, [("lang", "LogisticRegression", {"C": -2.0})], LANGS, stage="final", made=made)
    ledger.repair(book, rows, LANGS, made=made)
    return book.read().select("scenario", "model_name", "stage", "params", "status", "note", F.round("macro_f1_val", 4).alias("macro_f1_val"))


@query()
def l9_a31_model_comparison(spark, sf):
    """Every test document under each of four wanted models, by F1, one of which isn't there, and their vote."""
    train, val, test = splits(spark, sf)
    wanted = {"LR": ("LogisticRegression", {"C": 1.0, "max_iter": 20}), "LR_plain": ("LogisticRegression", {"C": 0.01, "max_iter": 20}), "SVC": ("LinearSVC", {"C": 1.0, "max_iter": 10})}
    texts, found = comparing.fit_all(train, val, wanted, LANGS, max_features=300)
    models = comparing.chained([*wanted, "Transformer"], found, "LR")
    return comparing.compared(texts.transform(test), "record_id", models).withColumns({"f1": F.round("f1", 4), "confidence": F.round("confidence", 4)})
