import corpus_pipeline as C
from reactrix.llm import common, decontam
from reactrix.llm.common import table

from . import test_decontam, test_rules, test_secrets, test_simhash
from .cases import DOC, awkward, empty, prose


def write(spark, folder, rows, items):
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def corpus():
    base = prose(70, 150)
    bench = prose(71, 30)
    rows = awkward() + [(600 + k, prose(600 + k, 100), "en", f"s{k % 3}", 1) for k in range(30)]
    rows += [(700, base, "en", "s0", 1), (701, base, "en", "s1", 1), (702, base + " more", "en", "s2", 1), (703, prose(72, 60) + " " + bench, "en", "s0", 1), (704, prose(73, 80) + " token=abcdef1234567890 tail", "en", "s1", 1)]
    return rows, [(1, bench)]


def test_stages_one_by_one(spark, tmp_path):
    rows, items = corpus()
    d = write(spark, str(tmp_path), rows, items)
    docs = table(spark, d, "documents")
    for name, stage in C.STAGES:
        before = sorted([tuple(r)[:5] for r in docs.collect()], key=repr)
        out = stage(spark, docs, d)
        after = [tuple(r)[:5] for r in out.collect()]
        if name == "quality_rules":
            kept = [r for r in before if not test_rules.slow(r[1])[-1]]
            assert set(after) <= set(kept) and {600, 700, 703, 704} <= {r[0] for r in after}
        elif name == "simhash":
            prints = [test_simhash.slow_print(r[1]) for r in before]
            groups = test_simhash.slow_classes(prints)
            least = {g: min((r[0] is None, r[0] or 0) for r, k in zip(before, groups) if k == g) for g in set(groups)}
            assert len(after) == len(least) and not {701, 702} & {r[0] for r in after}
            assert sorted((r[0] is None, r[0] or 0) for r in after) == sorted(least.values()) and set(after) <= set(before)
        elif name == "decontamination":
            bad = {x[0] for x in test_decontam.slow([r[:2] for r in before], items) if x[5]}
            assert bad == {703} and sorted(after, key=repr) == [r for r in before if r[0] != 703]
        elif name == "secrets":
            assert len(after) == len(before)
            text = {r[0]: r[1] for r in after}
            assert text[704].endswith("[SECRET] tail") and not test_secrets.slow(text[704])[2]
            assert all(r[4] == len(r[1]) for r in after)
        else:
            assert {"taken", "target", "size"} <= set(out.columns) and all(r.taken > 0 for r in out.collect())
        if name != "mixing":
            assert out.columns == docs.columns
        docs = out


def test_run_and_empty(spark, tmp_path):
    rows, items = corpus()
    assert C.run(spark, write(spark, str(tmp_path / "a"), rows, items)).count() > 10
    none = str(tmp_path / "b")
    empty(spark).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{none}/benchmark.parquet")
    assert C.run(spark, none).count() == 0
    assert decontam.digest(empty(spark), table(spark, none, "benchmark")).count() == 0


def test_extra_columns_stay(spark, tmp_path):
    rows, items = corpus()
    d = write(spark, str(tmp_path), rows, items)
    docs = table(spark, d, "documents").selectExpr("*", "1 as live", "2 as row", "3 as of_doc", "4 as kept", "5 as n_words", "6 as place", "7 as h", "8 as own_h", "9 as failed")
    for name, stage in C.STAGES:
        out = stage(spark, docs, d)
        assert set(docs.columns) <= set(out.columns), name
        assert out.select("live", "row", "of_doc", "kept", "n_words", "place", "h", "own_h", "failed").distinct().collect() == [(1, 2, 3, 4, 5, 6, 7, 8, 9)], name


def test_one_of_each_group_stays(spark, tmp_path):
    """Rows that share a doc_id but not a text, repeated rows, and copies without an id."""
    a, b = prose(80, 90), prose(81, 90)
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, b, "en", "s", 1), (3, b, "en", "s", 1), (None, a, "en", "s", 1), (None, prose(82, 90), "en", "s", 1), (None, prose(82, 90), "en", "s", 1)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(path)
    for docs in (spark.read.parquet(path), spark.createDataFrame(rows, DOC)):
        got = sorted((tuple(r)[:2] for r in C.near_duplicates(spark, docs, "").collect()), key=repr)
        assert got == sorted([(1, a), (2, b), (None, prose(82, 90))], key=repr)


def test_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    rows, items = corpus()
    d = write(spark, str(tmp_path), rows, items)
    docs, meet = table(spark, d, "documents"), C.meet
    want = [sorted(map(tuple, f(spark, docs, d).collect()), key=repr) for f in (C.near_duplicates, C.decontamination)]
    monkeypatch.setattr(C, "meet", lambda rows, small, same, how, n, a, b: meet(rows, small, same, how, n, a, b, -1))
    got = [sorted(map(tuple, f(spark, docs, d).collect()), key=repr) for f in (C.near_duplicates, C.decontamination)]
    assert len(got[0]) == len(want[0]) and got[1] == want[1]


def test_tables_on_the_way_are_removed(spark, tmp_path, monkeypatch):
    rows, items = corpus()
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    assert C.run(spark, write(spark, str(tmp_path / "a"), rows, items)).count() > 10
    left = [p.name for p in (tmp_path / "shared" / "reactrix").iterdir() if p.is_dir()]
    assert len(left) == 1 and left[0].startswith("mixing")


def test_without_n_chars(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token=abcdef1234567890", "s")], "doc_id bigint, text string, source string")
    assert [tuple(r) for r in C.secret_redaction(spark, docs, "").collect()] == [(1, "[SECRET]", "s")]
