import random
import re
from collections import Counter
from math import log, sqrt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reactrix.operators import crawl, evaluation, keyphrases, learning, matching, quality, ranges, ranking, sampling, similarity, vectors

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(st.lists(st.one_of(st.none(), st.integers(0, 5)), min_size=1, max_size=30))
def test_rank_pct_is_pandas(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "k bigint, v bigint")
    got = [r.p for r in ranking.rank_pct(df, "v", "p").orderBy("k").collect()]
    want = pd.Series(values, dtype=float).rank(pct=True) * 100
    assert [None if pd.isna(x) else pytest.approx(x) for x in want] == got


@FEW
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.sampled_from("ABC")), min_size=1, max_size=40))
def test_metrics_add_up(spark, pairs):
    df = spark.createDataFrame(pairs, "y_true string, y_pred string")
    labels = list("ABCD")
    o = evaluation.overall(df, labels).first()
    assert o.accuracy == pytest.approx(sum(a == b for a, b in pairs) / len(pairs)) == pytest.approx(o.micro_f1)
    f1 = []
    for x in labels:
        tp, p, t = sum(a == b == x for a, b in pairs), sum(b == x for _, b in pairs), sum(a == x for a, _ in pairs)
        f1.append(2 * tp / (p + t) if p + t else 0)
    assert o.macro_f1 == pytest.approx(sum(f1) / 4)
    c = evaluation.confusion(df, labels).collect()
    assert sum(r[x] for r in c for x in labels) == len(pairs) and len(c) == 4
    assert all(sum(r[x] for x in labels) == pytest.approx(1) or r.y_true not in {a for a, _ in pairs} for r in evaluation.confusion(df, labels, True).collect())


def test_top_k_and_first(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 9)], "id bigint, v bigint")
    assert [r.id for r in ranking.top_k(df, "v", 2, "id").collect()] == [4, 1]
    dup = spark.createDataFrame([("a", 2), ("a", 1), (None, 3)], "k string, n bigint")
    assert sorted((r.k or "", r.n) for r in ranking.distinct_first(dup, ["k"], "n").collect()) == [("", 3), ("a", 1)]


def grams(t):
    p = f" {t} "
    return Counter(p[i : i + k] for k in (2, 3, 4) for i in range(len(p) - k + 1))


def test_fuzzy_match_is_exhaustive(spark):
    left = [(k, t) for k, t in enumerate(["hello world again", "helo world again", "nothing alike", "", None, "Hello World again", "aa", "hello world agains!"])]
    right = [(k, t) for k, t in enumerate(["hello world again", "hello world agains", "other words here", "", "hello world again", "aab"])]
    ldf, rdf = spark.createDataFrame(left, "l bigint, lt string"), spark.createDataFrame(right, "r bigint, rt string")
    got = {r.l: (r.match_r, pytest.approx(r.similarity)) for r in matching.fuzzy_match(ldf, rdf, "l", "r", "lt", "rt").collect()}
    key = lambda t: "".join((t or "").lower().split())
    docs = {}
    for k, t in right:
        if key(t):
            docs.setdefault(key(t), k)
    df = Counter(g for t in docs for g in grams(t))
    idf = {g: log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(t):
        w = {g: n * idf[g] for g, n in grams(t).items() if g in idf}
        n = sqrt(sum(x * x for x in w.values()))
        return {g: x / n for g, x in w.items()} if n else {}

    want = {}
    for k, t in left:
        if key(t):
            best = max(((sum(x * unit(d).get(g, 0) for g, x in unit(key(t)).items()), -r) for d, r in docs.items()), default=(0, 0))
            if best[0] > 0.85:
                want[k] = (-best[1], best[0])
    assert got == want and 1 in got and 2 not in got


def test_exact_match_fans_out(spark):
    left = spark.createDataFrame([(1, "A b"), (2, None)], "i bigint, t string")
    right = spark.createDataFrame([(1, "ab"), (2, "AB"), (3, "")], "j bigint, u string")
    assert sorted((r.i, r.j) for r in matching.exact_match(left, right, "t", "u").collect()) == [(1, 1), (1, 2), (2, 3)]
    assert sorted((r.i, r.j) for r in matching.exact_match_once(left, right, "t", "u", "j").collect()) == [(1, 1)]


def test_keyphrases(spark):
    df = spark.createDataFrame([("big red dog ran",), ("big red dog sat",), ("và",), (None,)], "t string")
    got = keyphrases.phrase_counts(df, "t", 2, 3, 2, 1.0).orderBy("phrase").collect()
    assert [(r.phrase, r.n, r.df) for r in got] == [("big red", 2, 2), ("big red dog", 2, 2), ("red dog", 2, 2)]
    one = spark.createDataFrame([("solo phrase",), ("other thing",)], "t string")
    assert [r.phrase for r in keyphrases.keyphrases(one, "t", 2).collect()] == ["other", "other thing"]


def test_sampling(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 3).alias("g"))
    quotas = spark.createDataFrame([(0, 5), (1, 100), (2, 0)], "g bigint, quota int")
    took = sampling.quota_grid(df, quotas, ["g"], "id", 1)
    assert {r.g: r["count"] for r in took.groupBy("g").count().collect()} == {0: 5, 1: 67}
    assert sampling.remainder(df, took, "id").count() == 200 - 72
    deal = sampling.round_robin(df, [("b", F.col("g") == 0), ("a", F.col("id") < 10)], 20, "id", 1).orderBy("turn").collect()
    assert len(deal) == len({r.id for r in deal}) == 20 and [r.pair for r in deal[:4]] == ["a", "b", "a", "b"] and sum(r.pair == "a" for r in deal) <= 10
    greedy = sampling.greedy_labels(df, [("x", F.col("g") == 0), ("y", F.col("id") < 30)], 10, "id").collect()
    assert len({r.id for r in greedy}) == 20 and all(r.n_other == 0 for r in greedy)


def test_accept_rules(spark):
    old = [False, True, False, True, True, True, False]
    df = spark.createDataFrame([("p", k, o) for k, o in enumerate(old)], "page string, n int, old boolean")
    assert sorted(r.n for r in crawl.accepted(df, "page", ["n"], "old", 3).collect()) == [0, 2]


def test_reactions(spark):
    df = spark.createDataFrame([({"like": 2, "odd": 3},), (None,), ({},)], "m map<string,bigint>")
    got = df.select(*crawl.reaction_columns(F.col("m")), crawl.total_reactions(F.col("m"), F.lit(7)).alias("t")).collect()
    assert [(r.like, r.care, r.t) for r in got] == [(2, 0, 5), (0, 0, 7), (0, 0, 7)]


def test_checks_and_ids(spark):
    a, b = spark.range(5), spark.range(2, 7)
    assert quality.same_ids(a, b, "id").first()[:] == (2, 2)
    rows = quality.checks(a, n=(F.count("*"), F.col("observed") == 5), top=(F.max("id"), F.col("observed") < 4)).collect()
    assert {(r.check, r.passed, r.observed) for r in rows} == {("n", True, 5), ("top", False, 4)}


def test_candidates():
    grid, texts = {"C": list(range(8))}, {"n": list(range(6))}
    first = learning.candidates("LogisticRegression", grid, texts)
    assert len(first) == 12 and {c["C"] for c in first} == {0, 1}
    deep = learning.candidates("LogisticRegression", grid, texts, deep=True)
    assert len(deep) == 40 and deep == learning.candidates("LogisticRegression", grid, texts, deep=True)


def test_picked_settings_are_distinct_and_cost_what_is_picked():
    axes = [list("abc"), [1, 2], [True, False, None], list(range(5))]
    import itertools

    assert [learning.settings(k, axes) for k in range(90)] == [list(v) for v in itertools.product(*axes)]
    for n in (41, 64, 90, 97, 10**30):
        got = learning.picked(n, 40, 7)
        assert len(set(got)) == 40 and got == sorted(got) == learning.picked(n, 40, 7) and 0 <= got[0] and got[-1] < n and got != learning.picked(n, 40, 8)
    assert learning.picked(30, 40, 7) == list(range(30)) and learning.picked(90, 12, None) == list(range(12))
    huge = learning.candidates("LinearSVC", {f"p{k}": list(range(100)) for k in range(20)}, {}, deep=True)
    assert len({tuple(c.values()) for c in huge}) == 45


def test_failed_fits(spark):
    rows = [(k, f"{'alpha beta' if k % 2 else 'gamma delta'} w{k}", "AB"[k % 2]) for k in range(40)]
    df = spark.createDataFrame(rows, "record_id bigint, text string, y_true string").cache()
    model, note = learning.fit("LogisticRegression", df, min_df=10**6, max_iter=5)
    assert note.startswith("fallback") and learning.predict(model, df).where("y_true <> y_pred").count() == 0
    got = learning.trials(df, df, {"LogisticRegression": [{"max_iter": 5}, {"min_df": 10**6}]}, ["A", "B"]).orderBy("trial_id").collect()
    assert [r.status.split(":")[0] for r in got] == ["success", "failed"] and got[0].macro_f1_val == 1.0 and got[1].macro_f1_val is None


def test_quantiles_are_exact(spark, monkeypatch):
    """Groups over several ranges, null groups and values, ties, against pandas."""
    monkeypatch.setattr(ranges.in_ranges, "__kwdefaults__", {"rows": 7})
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.random(), float(rng.randint(0, 5))])) for _ in range(400)] + [("c", 1.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = pd.DataFrame(rows, columns=["g", "v"])
    for groups in ([], ["g"]):
        got = ranges.quantiles(df, groups, "v", low=0.1, mid=0.5, high=0.93).collect()
        for r in got:
            v = want if not groups else want[want.g.isna() if r.g is None else want.g == r.g]
            assert [r.low, r.mid, r.high] == pytest.approx([v.v.quantile(q) for q in (0.1, 0.5, 0.93)])
        assert len(got) == (4 if groups else 1)
    assert ranges.quantiles(df.where("v > 99"), [], "v", mid=0.5).first().mid is None


def test_row_numbers_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges.in_ranges, "__kwdefaults__", {"rows": 7})
    df = spark.range(100).selectExpr("id", "if(id % 9 = 0, null, id % 10) as v")
    got = ranges.row_numbers(df, [F.col("v").desc_nulls_last(), F.col("id")], "n").orderBy("n").collect()
    rows = sorted(range(100), key=lambda k: (k % 9 == 0, 0 if k % 9 == 0 else -(k % 10), k))
    assert [(r.id, r.n) for r in got] == [(k, n) for n, k in enumerate(rows, 1)]


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5))
    m[10], m[20], m[30] = m[5], m[5], 0
    rows = [(k, v.tolist()) for k, v in enumerate(m)] + [(99, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>").repartition(4)
    unit = np.array(df.orderBy("id").limit(60).toPandas()["v"].tolist(), float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    c = np.round(unit @ unit.T, 9)
    np.fill_diagonal(c, -2)
    for block in (4096, 5):
        got = {r["query"]: r.vec for r in similarity.nearest(df.where("id % 5 = 0 and v is not null"), df, "id", "v", block).collect()}
        assert got == {k: int(c[k].argmax()) for k in range(0, 60, 5)}


def clustered(n, d, groups, seed=5, copies=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(groups, d))[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.15
    m[:copies] = m[0]
    return m.astype(np.float32)


def best(m, ids):
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    out = {}
    for k in ids:
        c = np.round(u @ u[k], 9)
        c[k] = -2
        out[k] = int(c.argmax())
    return out


@pytest.mark.parametrize("copies,block", [(0, 64), (150, 16), (400, 2048)])
def test_the_index_is_exact_on_clusters_and_copies(spark, copies, block):
    m = clustered(450, 12, 9, copies=copies)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id bigint, v array<float>").repartition(4)
    got = {r["query"]: r.vec for r in similarity.nearest(df.where("id % 7 = 0"), df, "id", "v", block, cells=12).collect()}
    assert got == best(m, range(0, 450, 7))


def test_few_probes_find_most(spark):
    m = clustered(900, 16, 20)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id bigint, v array<float>").repartition(4)
    want = best(m, range(0, 900, 20))
    found = {r["query"]: r.vec for r in similarity.nearest(df.where("id % 20 = 0"), df, "id", "v", cells=40, probes=6).collect()}
    recall = sum(found.get(k) == v for k, v in want.items()) / len(want)
    assert recall >= 0.9, recall


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, v array<float>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, v array<float>")
    assert similarity.nearest(none, none, "id", "v").count() == 0 and similarity.nearest(one, one, "id", "v").count() == 0 and similarity.nearest(none, one, "id", "v").count() == 0


def test_pruned_cells_are_not_visited():
    at = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    import pyarrow as pa

    class Sent:
        value = at

    row = pa.RecordBatch.from_arrays([pa.array([[1.0, 0.1]], pa.list_(pa.float64())), pa.array([7]), pa.array([7]), pa.array([0], pa.int32()), pa.array([0.2])], names=["v", "q", "gid", "cell", "reach"])
    run = lambda reach, probes=None: [(c, p) for b in similarity.visits(Sent, {0: 2, 1: 3, 2: 1}, {0: 0.5, 1: 0.3, 2: 0.1}, False, probes)([row.set_column(4, "reach", pa.array([reach]))]) for c, p in zip(b.column("cell").to_pylist(), b.column("part").to_pylist())]
    assert run(0.2) == [] and run(1.2) == [(1, 0), (1, 1), (1, 2)] and {c for c, _ in run(9.0)} == {1, 2} and {c for c, _ in run(9.0, 2)} == {1}


def test_exact_groups(spark):
    left = spark.createDataFrame([(1, "A b"), (2, "c"), (3, "ab")], "i int, t string")
    right = spark.createDataFrame([(7, "ab"), (5, "AB "), (6, "x")], "j int, u string")
    assert sorted(tuple(r) for r in matching.exact_groups(left, right, "t", "u", "j").select("i", "j", "n").collect()) == [(1, 5, 2), (3, 5, 2)]


@pytest.mark.parametrize("model", ["LogisticRegression", "LinearSVC", "RandomForest", "GradientBoosting"])
def test_each_family_learns_held_out_labels(spark, model):
    rng = random.Random(6)
    said = {"one": "alpha beta gamma delta", "two": "zeta theta kappa sigma", "three": "omega psi chi phi"}
    rows = [(k, " ".join(rng.choice(said[y].split() + ["and", "or"]) for _ in range(12)), y) for k in range(150) for y in [list(said)[k % 3]]]
    df = spark.createDataFrame(rows, "record_id int, text string, y_true string")
    fitted, note = learning.fit(model, df.where("record_id < 100"), max_features=30, n_estimators=5, max_depth=3, max_iter=10)
    got = learning.predict(fitted, df.where("record_id >= 100")).collect()
    assert not note.startswith("fallback") and np.mean([r.y_true == r.y_pred for r in got]) > 0.85  # ten iterations may not converge, and the note says so


def plain_grams(text, analyzer, low, high):
    """The n-grams of one text, written out."""
    words = (text or "").lower().split()
    if analyzer == "word":
        words = [w for w in re.findall(r"\w+", (text or "").lower()) if len(w) > 1]
        return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]
    padded = [f" {w} " for w in words]
    return [g for p in padded for g in ([p] if len(p) < low else [p[i : i + n] for n in range(low, high + 1) for i in range(len(p) - n + 1)])]


@pytest.mark.parametrize(("analyzer", "low", "high"), [("word", 1, 1), ("word", 1, 3), ("char_wb", 2, 4), ("char_wb", 4, 6)])
def test_vectors_match_a_plain_version(spark, analyzer, low, high):
    texts = ["big red dog, red cat", "Big red é cat a", "", None, "red red red", "a b c", "dog cat dog big", "big red dog, red cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for sublinear in (False, True):
        made = vectors.Vectorizer(df, "t", analyzer, (low, high), min_df=2, max_df=0.7, max_features=6, sublinear_tf=sublinear)
        tf = [Counter(plain_grams(t, analyzer, low, high)) for t in texts]
        df_of, total = Counter(g for c in tf for g in c), sum(tf, Counter())
        kept = sorted((g for g, n in df_of.items() if 2 <= n <= 0.7 * len(texts)), key=lambda g: (-total[g], g))[:6]
        assert [g for g, _ in made.places] == sorted(kept) and kept
        idf = [log((1 + len(texts)) / (1 + df_of[g])) + 1 for g in sorted(kept)]
        for r in made.transform(df).collect():
            want = np.array([((1 + log(tf[r.k][g])) if sublinear else tf[r.k][g]) * w if tf[r.k][g] else 0.0 for g, w in zip(sorted(kept), idf, strict=True)])
            assert np.allclose(r.features.toArray(), want / (np.linalg.norm(want) or 1)), texts[r.k]


def test_boosting_stops_early_on_the_validation_rows(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["alpha beta", "gamma delta"]), rng.choice("AB")) for k in range(60)]
    df = spark.createDataFrame(rows, "record_id int, text string, y_true string")
    train, val = df.where("record_id < 40"), df.where("record_id >= 40")
    sizes = [learning.fit("GradientBoosting", train, v, n_estimators=12, max_depth=2)[0].models[0].getNumTrees for v in (None, val)]
    assert sizes[0] == 12 and sizes[1] < 12


TRIAL = "trial_id int, scenario string, model_name string, status string, macro_f1_val double, weighted_f1_val double, accuracy_val double, size int, fell boolean"


def test_diagnostics_of_a_search(spark):
    rows = [
        (1, "S", "A", "success", 0.900, 0.7, 0.5, 9, None), (2, "S", "B", "success", 0.898, 0.8, None, 9, True), (3, "S", "C", "success", 0.898, 0.8, 0.1, 9, False),
        (4, "S", "D", "success", 0.898, 0.8, 0.1, 2, True), (5, "S", "E", "success", 0.880, 0.99, 0.9, 1, False), (6, "S", "F", "failed", 0.99, 0.99, 0.99, 1, None), (7, "S", "G", "failed", None, None, None, 1, True),
    ]
    got = evaluation.diagnostics(spark.createDataFrame(rows, TRIAL), F.col("fell"), [F.col("size")]).first()
    assert (got.total, got.success, got.failed, got.fallback, got.scored) == (7, 5, 2, 3, 6)
    assert (got.best_trial_id, got.best_model, got.best_macro_f1) == (4, "D", 0.898), "within the tolerance the weighted F1, the accuracy and the size decide"
    for none in ([], [rows[6]]):
        got = evaluation.diagnostics(spark.createDataFrame(none, TRIAL), F.col("fell"), [F.col("size")]).first()
        assert got.total == len(none) and got.best_trial_id is None


def test_nested_results_become_flat_rows(spark):
    kind = "run string, texts struct<analyzer:string,ngram_range:array<int>>, own struct<C:double>, v map<string,double>, t map<string,double>"
    rows = [("a", ("word", [1, 2]), (0.5,), {"accuracy": 0.5, "macro_f1": 0.25}, None), ("b", (None, None), (None,), {}, {"micro_f1": 1.0}), ("c", None, None, None, None)]
    flat = evaluation.flat_results(spark.createDataFrame(rows, kind), {"v": "val", "t": "test"}, {"texts": ("text_", ["analyzer", "ngram_range"]), "own": ("", ["C", "depth"])})
    assert flat.columns[:8] == ["run", "texts_json", "text_analyzer", "text_ngram_range", "own_json", "C", "depth", "accuracy_val"] and len(flat.columns) == 7 + 20
    a, b, c = flat.orderBy("run").collect()
    assert (a.text_ngram_range, a.own_json, a.C, a.depth, a.accuracy_val, a.macro_f1_val, a.accuracy_test) == ("(1, 2)", '{"C":0.5}', 0.5, None, 0.5, 0.25, None)
    assert (b.texts_json, b.text_ngram_range, b.micro_f1_test, b.accuracy_val) == ("{}", None, 1.0, None)
    assert c.texts_json is None and c.C is None and c.accuracy_val is None
