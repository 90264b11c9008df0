import json

import pytest
from pyspark.sql import functions as F

from reactrix.sources import readers, sinks
from reactrix.streaming import incremental


def test_csv_with_byte_order_mark_and_line_breaks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿post_id,content,comment_ids,extra\n1,"two\nlines",c,x\n2,"say ""hi""",,y\n3,"two\nlines",c,z\n'.encode())
    q = tmp_path / "b.csv"
    q.write_text("comment_ids,post_id,content\nd,4,other\n")
    rows = readers.labelled_posts(spark, [str(p)]).unionByName(readers.labelled_posts(spark, [str(q)])).collect()
    assert sorted((r.post_id, r.content) for r in rows) == [("1", "two\nlines"), ("4", "other")]
    back = str(tmp_path / "out")
    sinks.to_csv(spark.createDataFrame([(1, "a\"b", [1, 2])], "k int, t string, l array<int>"), back, mark=True)
    r = readers.csv(spark, back, "k int, t string, l string, gone double").first()
    assert (r.k, r.t, r.l, r.gone) == (1, 'a"b', "[1,2]", None)


def test_crawled_posts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.json").write_text(json.dumps([{"post_id": "1", "post_content": "x", "reactions_detail": {"like": 3}}, {"post_id": "2", "post_content": ""}]))
    (tmp_path / "sub" / "two.jsonl").write_text('{"post_id": "3", "post_content": "y"}\nbroken\n{"post_id": "4"}\n')
    (tmp_path / "comments.json").write_text(json.dumps([{"post_id": "9", "post_content": "no"}]))
    got = sorted((r.post_id, r.json_source, r.reactions_detail) for r in readers.crawled_posts(spark, str(tmp_path)).collect())
    assert got == [("1", "one.json", {"like": 3}), ("3", "two.jsonl", None)]


def test_dictionary_shapes(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({
        "ko": {"normalized": ["không"], "response": {"ko": {"normalized": [{"word": "không"}]}}}, "dc": {"normalized": ["được", "điện"], "response": {"normalized": {"word": "được"}}},
        "hn": {"normalized": [], "response": [{"normalized": [{"word": "a"}, {"word": "b"}]}, {"normalized": {"word": "c"}}]}, "BAD": {"normalized": ["x"], "response": {}}}))
    got = {r.word: (r.candidates, [d["word"] for d in r.details]) for r in readers.dictionary(spark, str(p), ["bad"]).collect()}
    assert got == {"ko": (["không"], ["không"]), "dc": (["được", "điện"], ["được"]), "hn": ([], ["a", "b", "c"])}


def test_splits_and_text_column(spark, tmp_path):
    for name in ("deep/x/train.csv", "a_train_v1.csv", "val-set.csv", "my.test.csv", "latest.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("a\n1\n")
    found = {k: v.rsplit("/", 1)[-1] for k, v in readers.split_paths(spark, str(tmp_path)).items()}
    assert found == {"train": "a_train_v1.csv", "val": "val-set.csv", "test": "my.test.csv"}
    (tmp_path / "val-set.csv").unlink()
    with pytest.raises(FileNotFoundError):
        readers.split_paths(spark, str(tmp_path))
    frames = [spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1, 2)], "b int, c int")]
    assert readers.text_column(frames, ["a", "b"]) == "b"
    with pytest.raises(ValueError):
        readers.text_column(frames, ["a"])


def test_cache_or_recompute(spark, tmp_path):
    path, raw, made = str(tmp_path / "cache"), tmp_path / "raw", []

    def compute(_):
        made.append(1)
        return spark.range(len(made))

    with pytest.raises(FileNotFoundError):
        readers.cached(spark, path, str(raw), compute)
    raw.write_text("x")
    assert readers.cached(spark, path, str(raw), compute).count() == 1
    assert readers.cached(spark, path, str(raw), compute).count() == 1
    assert readers.cached(spark, path, str(raw), compute, fresh=True).count() == 2
    raw.unlink()
    assert readers.cached(spark, path, str(raw), compute, fresh=True).count() == 2


def test_predictions_missing_is_empty(spark, tmp_path):
    f = tmp_path / "S1" / "M1"
    f.mkdir(parents=True)
    (f / "predictions_test.csv").write_text("record_id,y_true,y_pred,confidence\n1,A,B,0.5\n")
    assert readers.predictions(spark, str(tmp_path), "S1", "M1", "test").first()[:] == ("1", "A", "B", 0.5, "S1", "M1", "test")
    assert readers.predictions(spark, str(tmp_path), "S1", "M1", "val").count() == 0
    assert readers.predictions(spark, str(tmp_path / "none"), "S1", "M1", "val").count() == 0


def test_markdown(spark):
    df = spark.createDataFrame([(2, "a|b", 0.5), (1, None, None)], "k int, t string, v double")
    assert sinks.markdown(df, ["k"]).first().markdown.split("\n")[2:] == ["| 1 |  |  |", "| 2 | a\\|b | 0.5000 |"]


def test_stream_appends_each_key_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for batch in ([("1", "u1", "a"), ("2", None, "same start"), ("3", None, "same start")], [("4", "u1", "b"), ("5", "u2", "c")]):
        spark.createDataFrame(batch, "post_id string, post_url string, post_content string").coalesce(1).write.mode("append").json(folder)
        incremental.ingest(spark, folder, out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.post_content for r in rows) == ["a", "c", "same start"]


def test_posts_without_address_and_text_are_appended_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(2):
        spark.createDataFrame([(str(k),)], "post_id string").write.mode("append").json(folder)
        incremental.ingest(spark, folder, out, state).awaitTermination()
    assert [(r.post_key, r.post_id) for r in spark.read.parquet(out).collect()] == [("", "0")]


def test_batches_never_read_what_was_written(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    posts = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("post_id"), F.concat(F.lit("u"), "id").alias("post_url"), F.lit("t").alias("post_content"))
    posts(0, 500).write.json(folder)
    first = incremental.ingest(spark, folder, out, state)
    first.awaitTermination()
    for f in (tmp_path / "out").glob("*.parquet"):  # the target is gone, what was seen is not
        f.unlink()
    posts(490, 520).write.mode("append").json(folder)
    query = incremental.ingest(spark, folder, out, state)  # a new run goes on from the checkpoint
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in first.recentProgress) == 500 and sum(p["numInputRows"] for p in query.recentProgress) == 30
    assert sorted(int(r.post_id) for r in spark.read.schema("post_id string").parquet(*map(str, (tmp_path / "out").glob("*.parquet"))).collect()) == list(range(500, 520))


def test_the_first_of_a_batchs_equal_posts_by_time_then_id(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([("3", "u", None), ("2", "u", 7), ("1", "u", 8), ("0", "u", 7)], "post_id string, post_url string, creation_time bigint").repartition(3).write.json(folder)
    incremental.ingest(spark, folder, out, state).awaitTermination()
    assert [r.post_id for r in spark.read.parquet(out).collect()] == ["0"]


def test_pages_stop_after_three_old_posts_in_a_row_over_batches(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    marks = {"a": "nnoonoonnooonn", "b": "ooonnn", "c": "nonononooxoonnn", "d": "n"}  # n: new, o: old, x: new but not to keep
    rows = [(page, k, m == "o", m == "n") for page, said in marks.items() for k, m in enumerate(said)]
    schema = "page string, k int, old boolean, keep boolean"
    for part in ([r for r in rows if r[1] < 9], [r for r in rows if 9 <= r[1] < 12], [r for r in rows if r[1] >= 12]):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").json(folder)
        stream = incremental.follow_pages(spark.readStream.schema(schema).json(folder), "page", ["k"], F.col("old"), F.col("keep"))
        incremental.append(stream, out, state).awaitTermination()
    want = []
    for page, said in marks.items():
        run = 0
        for k, m in enumerate(said):
            run = run + 1 if m == "o" else 0
            if run == 3:
                break
            if m == "n":
                want.append((page, k))
    assert sorted((r.page, r.k) for r in spark.read.parquet(out).collect()) == sorted(want)


def test_crawl_names_the_files_that_fail(spark, tmp_path):
    post = lambda k: json.dumps({"post_id": str(k), "post_content": f"text\n{k}"})
    made = {
        "good.json": f"[{post(1)}, 5, \"x\", null, [1], {post(2)}]\n", "empty.json": "[]", "cut.json": f"[{post(3)}, {post(4)[:9]}", "object.json": post(5), "words.json": "no json", "tail.json": f"[{post(6)}] and more",
        "lines.jsonl": "\n".join([post(7), "", post(8), "{broken", post(9), post(10)]), "array.jsonl": f"{post(11)}\n[1]\n{post(12)}", "fine.jsonl": post(13) + "\n\n", "my_comments.json": f"[{post(14)}]", "none.json": json.dumps([{"post_id": "15"}, {"post_content": ""}])}
    (tmp_path / "deep").mkdir()
    for k, (name, text) in enumerate(made.items()):
        (tmp_path / ("deep" if k % 2 else ".") / name).write_text(text)
    posts, failures = readers.crawl(spark, str(tmp_path))
    assert sorted((int(r.post_id), r.json_source) for r in posts.collect()) == [(1, "good.json"), (2, "good.json"), (7, "lines.jsonl"), (8, "lines.jsonl"), (11, "array.jsonl"), (13, "fine.jsonl")]
    assert {tuple(r) for r in failures.collect()} == {
        ("cut.json", "invalid JSON", 0), ("object.json", "not an array", 0), ("words.json", "invalid JSON", 0), ("tail.json", "invalid JSON", 0), ("lines.jsonl", "broken line", 3), ("array.jsonl", "broken line", 2)}
    (tmp_path / "nothing").mkdir()
    assert all(d.count() == 0 for d in readers.crawl(spark, str(tmp_path / "nothing")))


def test_a_long_file_of_lines_is_taken_up_to_its_first_broken_line(spark, tmp_path):
    lines = [json.dumps({"post_id": str(k), "post_content": "x" * 200}) for k in range(4000)]
    lines[2500], lines[3000] = "broken", "broken too"
    (tmp_path / "long.jsonl").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")  # many splits
    try:
        posts, failures = readers.crawl(spark, str(tmp_path))
        assert sorted(int(r.post_id) for r in posts.collect()) == list(range(2500))
        assert [tuple(r) for r in failures.collect()] == [("long.jsonl", "broken line", 1500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_folders_of_part_files_are_splits(spark, tmp_path):
    for name in ("a_train.csv", "deep/train.csv", "val-1.csv", "my.test.csv", "latest.csv"):
        sinks.to_csv(spark.range(10).repartition(2), str(tmp_path / name))
    assert {k: v.rsplit("/", 1)[-1] for k, v in readers.split_paths(spark, str(tmp_path)).items()} == {"train": "a_train.csv", "val": "val-1.csv", "test": "my.test.csv"}


def test_markdown_of_a_whole_table(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("a|"), "id").alias("t"), F.when(F.col("id") > 0, F.col("id") / 2).alias("v")).repartition(5)
    path = str(tmp_path / "table")
    sinks.to_markdown(df, path, ["k"], bold=F.col("k") % 1000 == 0)
    parts = [f.read_text() for f in sorted((tmp_path / "table").glob("*/part-*"))]
    lines = "".join(parts).splitlines()
    assert lines[:4] == ["| k | t | v |", "| --- | --- | --- |", "| **0** | **a\\|0** |  |", "| 1 | a\\|1 | 0.5000 |"]
    assert len(lines) == 5002 and lines[-1] == "| 4999 | a\\|4999 | 2499.5000 |" and lines[1002] == "| **1000** | **a\\|1000** | **500.0000** |"
