"""Boosting against a plain version, convergence, the ledger of trials, and models side by side."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector, SparseVector
from pyspark.sql import functions as F

from reactrix.operators import boosting as B
from reactrix.operators import comparing, evaluation, learning, ledger

SAID = {"one": "alpha beta gamma delta", "two": "zeta theta kappa sigma", "three": "omega psi chi phi"}


def texts(n=150, noise=0.0, seed=6):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        y = list(SAID)[k % 3]
        words = " ".join(rng.choice(SAID[rng.choice(list(SAID)) if rng.random() < noise else y].split() + ["and", "or"]) for _ in range(12))
        out.append((k, words, y))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, text string, y_true string").repartition(3)


def vectors(spark, n=240, d=6, seed=2):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, d)) < 0.6, rng.random((n, d)) * 4, 0.0).round(2)
    label = ((x[:, 0] > 1.5).astype(int) + (x[:, 1] + x[:, 2] > 3)).astype(int)
    rows = [(k, SparseVector(d, {j: float(v) for j, v in enumerate(r) if v}) if k % 2 else DenseVector(r.tolist()), int(y), 1.0 + k % 3, k % 4 == 0) for k, (r, y) in enumerate(zip(x, label))]
    return x, label, spark.createDataFrame(rows, ["id", "features", "label", "weight", "held"]).repartition(4)


def plain(x, label, weight, held, cuts, rounds, depth, rate, ridge, least):
    """The same trees, grown over one matrix of bins: margins of all rows, and the losses before each round."""
    n, k = len(x), label.max() + 1
    bins = np.zeros(x.shape, int)
    for j in range(x.shape[1]):
        bins[:, j] = np.where(x[:, j] != 0, 1 + np.searchsorted(cuts.get(j, np.zeros(0)), x[:, j], "left"), 0)
    f, losses = np.zeros((n, k)), []

    def grow(rows, g, h, level):
        value = -rate * g[rows].sum() / (h[rows].sum() + ridge)
        best = (1e-6, None)
        if level < depth:
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
            for j in range(x.shape[1]):
                for cut in [b - 1 for b in np.unique(bins[rows, j]) if b > 0]:
                    left, right = rows & (bins[:, j] <= cut), rows & (bins[:, j] > cut)
                    if h[left].sum() >= least and h[right].sum() >= least:
                        gain = round(score(left) + score(right) - score(rows), 9)
                        if gain > best[0]:
                            best = (gain, (j, cut))
        if best[1] is None:
            return lambda at: np.full(at.sum(), value)
        j, cut = best[1]
        low, high = grow(rows & (bins[:, j] <= cut), g, h, level + 1), grow(rows & (bins[:, j] > cut), g, h, level + 1)

        def said(at):
            out, right = np.zeros(n), bins[:, j] > cut
            out[at & ~right], out[at & right] = low(at & ~right), high(at & right)
            return out[at]

        return said

    for _ in range(rounds + 1):
        p = B.softmax(f)
        own = -np.log(p[np.arange(n), label])
        losses.append((np.average(own[~held], weights=weight[~held]), np.average(own[held], weights=weight[held])))
        if len(losses) > rounds:
            break
        w, step = np.where(held, 0, weight), np.zeros((n, k))
        for c in range(k):
            g, h = w * (p[:, c] - (label == c)), w * np.maximum(p[:, c] * (1 - p[:, c]), 1e-16)
            step[:, c] = grow(~held, g, h, 0)(np.ones(n, bool))
        f = f + step
    return f, losses


@pytest.mark.parametrize("depth", [1, 3])
def test_boosting_grows_the_plain_trees(spark, depth):
    x, label, df = vectors(spark)
    k = np.arange(len(x))
    model = B.fit(df, 3, rounds=4, depth=depth, rate=0.4, patience=9)
    f, losses = plain(x, label, 1.0 + k % 3, k % 4 == 0, model.cuts, 4, depth, 0.4, 1.0, 1e-3)
    assert np.allclose(model.losses, [a for a, _ in losses]) and np.allclose(model.held_losses, [b for _, b in losses])
    got = B.transform(model, df, "id").orderBy("id").collect()
    best = int(np.argmin([b for _, b in losses]))
    assert len(model.rounds) == best
    if best == 4:
        assert np.allclose([r.scores for r in got], B.softmax(f), atol=1e-9)
    assert model.losses[-1] < model.losses[0]


def test_boosting_stops_early_and_without_validation_rows_goes_on(spark):
    _, _, df = vectors(spark)
    noise = df.withColumn("label", F.when(F.col("held"), (F.col("label") + 1) % 3).otherwise(F.col("label")))  # what helps training rows hurts these
    stopped = B.fit(noise, 3, rounds=8, depth=2, patience=2)
    assert len(stopped.rounds) == 0 and len(stopped.held_losses) == 3
    assert len(B.fit(df.where("not held"), 3, rounds=2, depth=1).rounds) == 2


def test_boosting_is_no_worse_than_one_model_a_label(spark):
    train, val, test = (frame(spark, texts(n, 0.15, s)) for n, s in ((120, 1), (60, 2), (90, 3)))
    f1 = {}
    for model, p in (("SoftmaxBoosting", {"n_estimators": 6, "max_depth": 2}), ("GradientBoosting", {"n_estimators": 6, "max_depth": 2})):
        fitted, note = learning.fit(model, train, val, max_features=50, **p)
        assert note == ""
        f1[model] = evaluation.overall(learning.predict(fitted, test), list(SAID)).first().macro_f1
    assert f1["SoftmaxBoosting"] >= f1["GradientBoosting"] - 0.02 and f1["SoftmaxBoosting"] > 0.8


@pytest.mark.parametrize("model", ["LogisticRegression", "LinearSVC"])
def test_a_fit_that_does_not_converge_is_told_and_repeated(spark, model):
    train = frame(spark, texts(90, 0.3))
    _, note = learning.fit(model, train, max_iter=2)
    assert note.startswith("not converged after 2 iterations; fitted again with 8")
    fitted, note = learning.fit(model, train, max_iter=500)
    assert note == "" and fitted.stopped == 0


def test_what_is_not_the_candidates_fault_ends_the_run(spark, monkeypatch):
    def lost(*_, **__):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(learning, "train_one", lost)
    with pytest.raises(RuntimeError):
        learning.trials(frame(spark, texts(9)), frame(spark, texts(9)), {"LogisticRegression": [{}]}, list(SAID))


def test_a_killed_search_resumes(spark, tmp_path, monkeypatch):
    train, val = frame(spark, texts(60)), frame(spark, texts(30, seed=9))
    book, rows = ledger.Ledger(spark, str(tmp_path / "ledger")), {"s": (train, val)}
    tries = [("s", "LogisticRegression", {"C": c, "max_iter": 30}) for c in (1.0, 0.5, 0.1, -1.0)]
    fits, fit = [], ledger.fit

    def counted(model, *a, **p):
        fits.append(p["C"])
        if len(fits) == 3:
            raise RuntimeError("killed")
        return fit(model, *a, **p)

    monkeypatch.setattr(ledger, "fit", counted)
    assert len(book.pending(tries)) == 4 and book.read().count() == 0
    with pytest.raises(RuntimeError):
        ledger.run(book, rows, tries, list(SAID))
    assert book.read().count() == 2
    table = ledger.run(ledger.Ledger(spark, str(tmp_path / "ledger")), rows, tries, list(SAID)).collect()
    assert fits == [1.0, 0.5, 0.1, 0.1, -1.0], "what was finished isn't fitted again"
    assert sorted(r.status for r in table) == ["failed", "success", "success", "success"] and len({r.key for r in table}) == 4
    assert all(r.macro_f1_val is None and r.note.startswith("IllegalArgumentException") for r in table if r.status == "failed")
    assert ledger.run(book, rows, tries, list(SAID)).count() == 4 and len(fits) == 5


def test_a_failed_final_is_fitted_anew(spark, tmp_path):
    train, val = frame(spark, texts(60)), frame(spark, texts(30, seed=9))
    book, rows = ledger.Ledger(spark, str(tmp_path / "ledger")), {"s": (train, val)}
    ledger.run(book, rows, [("s", "LogisticRegression", {"C": 1.0, "max_iter": 30})], list(SAID))
    ledger.run(book, rows, [("s", "LogisticRegression", {"C": -1.0}), ("s", "LinearSVC", {"C": -1.0})], list(SAID), "final")
    finals = {r.model_name: r for r in ledger.repair(book, rows, list(SAID)).collect()}
    assert finals["LogisticRegression"].status == "success" and finals["LogisticRegression"].macro_f1_val == 1.0 and finals["LogisticRegression"].note.startswith("repaired from trial")
    assert finals["LinearSVC"].status == "failed", "there is no trial to repair it from"
    before = book.read().count()
    ledger.repair(book, rows, list(SAID))
    assert book.read().count() == before


def test_models_side_by_side(spark):
    train, val, test = (frame(spark, texts(n, 0.4, s)) for n, s in ((90, 1), (60, 2), (50, 3)))
    wanted = {"LR": ("LogisticRegression", {"C": 1.0, "max_iter": 100}), "weak": ("LogisticRegression", {"C": 0.0001, "max_iter": 100}), "SVC": ("LinearSVC", {"C": 1.0, "max_iter": 100})}
    made, found = comparing.fit_all(train, val, wanted, list(SAID), max_features=50)
    models = comparing.chained(["weak", "gone", "LR", "SVC"], found, "SVC")
    assert [(n, m.name, note) for n, m, note in models] == [("weak", "weak", ""), ("gone", "SVC", "fallback to SVC"), ("LR", "LR", ""), ("SVC", "SVC", "")]
    rows = comparing.compared(made.transform(test), "record_id", models).collect()
    by = {}
    for r in rows:
        by.setdefault(r.record_id, {})[r.model_name] = r
    order = [n for n, _, _ in sorted(models, key=lambda m: (-m[1].f1, m[0]))]
    assert len(by) == 50 and all([x.model_name for x in sorted(d.values(), key=lambda x: x.place)] == order for d in by.values())
    for name, (family, p) in wanted.items():  # as Spark's own model says
        fitted = learning.train_one(family, learning.weighted(train), None, p | {"max_features": 50})
        alone = {r.record_id: r for r in learning.predict(fitted, test).collect()}
        assert all(by[k][name].y_pred == alone[k].y_pred for k in by)
        if family == "LogisticRegression":
            assert all(by[k][name].confidence == pytest.approx(alone[k].confidence) for k in by)
        assert found[name].f1 == pytest.approx(evaluation.overall(learning.predict(fitted, val), list(SAID)).first().macro_f1)
    for d in by.values():
        said = [d[n].y_pred for n in order]
        want = max(said, key=lambda y: (said.count(y), -said.index(y)))
        assert {(r.vote, r.votes) for r in d.values()} == {(want, said.count(want))}
    with pytest.raises(ValueError):
        comparing.chained(["LR"], {}, "LR")
