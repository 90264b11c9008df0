"""What fits have in common is made once, and texts become vectors without a shuffle."""

import random
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from reactrix.operators import comparing, learning, ledger, vectors
from tests.test_learning import SAID, frame, texts
from tests.test_operators import plain_grams


@pytest.fixture
def reads(monkeypatch):
    """How often texts were counted for a vocabulary and turned into vectors."""
    n, made, transform = Counter(), vectors.Vectorizer.__init__, vectors.Vectorizer.transform

    def counted(self, *a, **p):
        n["counted"] += 1
        made(self, *a, **p)

    def turned(self, rows):
        n["turned"] += 1
        return transform(self, rows)

    monkeypatch.setattr(vectors.Vectorizer, "__init__", counted)
    monkeypatch.setattr(vectors.Vectorizer, "transform", turned)
    return n


def test_texts_become_vectors_in_place(spark):
    """No exchange, a row for a row, whatever the ids, in any number of slices."""
    df = frame(spark, texts(60))
    made = vectors.Vectorizer(df, "text", max_features=20)
    twice = df.unionByName(df.withColumn("text", F.lit(None).cast("string")))
    out = made.transform(twice)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (out, twice)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")
    assert out.count() == 120 and {r.features.numNonzeros() for r in out.where("text is null").collect()} == {0}


@pytest.mark.parametrize(("analyzer", "low", "high"), [("word", 1, 2), ("word", 2, 3), ("char_wb", 2, 3), ("char_wb", 5, 7)])
def test_many_small_hand_overs_and_slices_add_up(spark, monkeypatch, analyzer, low, high):
    """Counts and vectors don't depend on how many grams a task holds: against a plain version, and counts against the SQL form."""
    for name, n in (("TASK_GRAMS", 3), ("TASK_WORDS", 2), ("SLICE_ROWS", 2)):
        monkeypatch.setattr(vectors, name, n)
    rng = random.Random(4)
    alphabet = ["Ab", "a", "é", "É́x", "don't", "x_1", "ß", "İi", "٣٤", "áb", "東京", "🙂", "-", "Word", "word"]
    rows = [(k, rng.choice([" ", " ", "\t\n", "  "]).join(rng.choices(alphabet, k=rng.randint(0, 9))) if k % 9 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(2)
    got = df.select(vectors.spaced("t", analyzer).alias("t")).mapInArrow(vectors.counting(analyzer, low, high), "gram string, df bigint, total bigint").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    want = df.select("k", F.explode(vectors.text_grams("t", analyzer, (low, high))).alias("gram")).groupBy("gram").agg(F.countDistinct("k").alias("df"), F.count("*").alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    made = vectors.Vectorizer(df, "t", analyzer, (low, high), min_df=1, max_df=1.0)
    names, by = [g for g, _ in made.places], {r.k: Counter(r.g) for r in df.select("k", vectors.text_grams("t", analyzer, (low, high)).alias("g")).collect()}
    for r in made.transform(df).collect():
        want = np.array([(1 + log(by[r.k][g])) * w if by[r.k][g] else 0.0 for g, w in made.places])
        assert np.allclose(r.features.toArray(), want / (np.linalg.norm(want) or 1)) and len(names) == r.features.size


@pytest.mark.parametrize(("low", "high"), [(1, 2), (1, 3)])
def test_longer_grams_of_rare_words_are_left_out_without_loss(spark, low, high):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices([f"w{j}" for j in range(40)], [1 / (1 + j) for j in range(40)], k=30)) + (" the end" if k % 2 else "")) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, t string")
    for most, max_df in ((5, 0.95), (12, 0.5), (25, 1.0), (4000, 1.0)):
        got = vectors.Vectorizer(df, "t", "word", (low, high), min_df=2, max_df=max_df, max_features=most)
        cut = [plain_grams(t, "word", low, high) for _, t in rows]
        df_of, total = Counter(g for c in cut for g in set(c)), Counter(g for c in cut for g in c)
        want = sorted((g for g, n in df_of.items() if 2 <= n <= max_df * len(rows)), key=lambda g: (-total[g], g))[:most]
        assert [g for g, _ in got.ranked] == want and any(" " in g for g in want[:25])


def test_candidates_share_what_is_made_of_texts(spark, reads):
    """Three settings, one of which is fitted twice, and a smaller vocabulary of the same grams: one count, and two tables for each vocabulary."""
    train, val = frame(spark, texts(90, 0.3)), frame(spark, texts(30, seed=9))
    tries = {"LogisticRegression": [{"max_iter": 2}, {"C": 0.1, "max_iter": 40}, {"C": 0.5, "max_iter": 40}], "RandomForest": [{"max_features": 8, "n_estimators": 2}]}
    rows = learning.trials(train, val, tries, list(SAID)).collect()
    assert {r.status for r in rows} == {"success"} and rows[0].note.startswith("not converged")
    assert reads == {"counted": 1, "turned": 4}


def test_fewer_features_are_the_first_of_more(spark):
    train = frame(spark, texts(60))
    made = learning.Features(learning.weighted(train))
    made.texts({"max_features": 12})
    for p in ({"max_features": 5}, {"max_features": 30}, {"max_features": 7, "sublinear_tf": False}, {"max_features": 7}):
        own, alone = made.texts(p), vectors.Vectorizer(train, "text", **p)
        assert own.places == alone.places and own.sublinear == alone.sublinear
        assert all(np.array_equal(a.features.toArray(), b.features.toArray()) for a, b in zip(own.transform(train).orderBy("record_id").collect(), alone.transform(train).orderBy("record_id").collect(), strict=True))


def test_a_ledger_reads_texts_once_and_not_for_refused_settings(spark, tmp_path, reads):
    train, val = frame(spark, texts(60)), frame(spark, texts(30, seed=9))
    book, rows, made = ledger.Ledger(spark, str(tmp_path / "ledger")), {"s": (train, val)}, {}
    ledger.run(book, rows, [("s", "LogisticRegression", {"C": -1.0}), ("s", "LinearSVC", {"C": -1.0})], list(SAID), "final", made=made)
    assert not reads and {r.status for r in book.read().collect()} == {"failed"}
    tries = [("s", "LogisticRegression", {"C": c, "max_iter": 30}) for c in (1.0, 0.1, -1.0)]
    ledger.run(book, rows, tries, list(SAID), most=1, made=made)
    ledger.run(book, rows, tries, list(SAID), made=made)
    finals = {r.model_name: r for r in ledger.repair(book, rows, list(SAID), made=made).collect()}
    assert finals["LogisticRegression"].note.startswith("repaired from trial")
    assert reads == {"counted": 1, "turned": 2}


def test_models_side_by_side_share_their_features(spark, reads):
    train, val = frame(spark, texts(90, 0.4, 1)), frame(spark, texts(60, 0.4, 2))
    wanted = {"LR": ("LogisticRegression", {"max_iter": 20}), "weak": ("LogisticRegression", {"C": 0.001, "max_iter": 20}), "SVC": ("LinearSVC", {"max_iter": 10})}
    _, found = comparing.fit_all(train, val, wanted, list(SAID), max_features=50)
    assert set(found) == set(wanted) and reads == {"counted": 1, "turned": 2}
