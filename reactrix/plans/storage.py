"""Round trips through the readers, sinks and the stream, in Spark's own shared folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators.ranges import scratch
from ..operators.ranking import distinct_first
from ..sources import readers, sinks
from .fixture import POSTS, PREDICTIONS, posts, predictions, table
from .catalog import query


@query("WITH f AS (SELECT doc_id, text, source FROM documents), k AS (SELECT min(doc_id) AS post_id, text FROM f GROUP BY text) SELECT k.post_id::VARCHAR AS post_id, md5(k.text) AS content FROM k WHERE k.post_id % 2 = 0")
def s1_u5_csv_union(spark, sf):
    """Two CSV files read as one, one row for each text, then the posts among them."""
    d = table(spark, sf, "documents").select(F.lpad("doc_id", 12, "0").alias("post_id"), F.col("text").alias("content"), F.lit("x").alias("label_from_content"), F.when(F.col("doc_id") % 2 == 0, "c").alias("comment_ids"))
    paths = [scratch(spark, "csv") for _ in range(2)]
    for k, p in enumerate(paths):
        sinks.to_csv(d.where(F.col("post_id").cast("bigint") % 2 == k), p)
    return readers.labelled_posts(spark, paths).select(F.col("post_id").cast("bigint").cast("string").alias("post_id"), F.md5("content").alias("content"))


@query(f"WITH {POSTS} SELECT record_id::VARCHAR AS post_id, page_name, like_count, total_reactions FROM posts")
def s3_s11_json_scan(spark, sf):
    p = posts(spark, sf)
    out = p.select(F.col("record_id").cast("string").alias("post_id"), F.lit("text").alias("post_content"), "page_name", "total_reactions", F.create_map(F.lit("like"), "like_count").alias("reactions_detail"))
    path = scratch(spark, "json")
    sinks.to_json(out, path)
    # Spark writes JSON lines under .json names, so this folder is read as lines
    raw = spark.read.schema(readers.CRAWLED).json(path).where("post_content <> ''")
    return raw.select("post_id", "page_name", F.try_element_at("reactions_detail", F.lit("like")).alias("like_count"), "total_reactions")


@query(f"WITH {POSTS} SELECT page_name, count(*) AS n, round(avg(total_reactions), 6) AS mean_reactions FROM posts GROUP BY 1")
def s4_cached_table(spark, sf):
    path = scratch(spark, "cache")
    return readers.cached(spark, path, f"{sf}/orders.parquet", lambda raw: posts(spark, sf)).groupBy("page_name").agg(F.count("*").alias("n"), rounded(F.avg("total_reactions")).alias("mean_reactions"))


@query(f"WITH {POSTS} SELECT record_id, page_name FROM posts")
def s10_s15_csv_download(spark, sf):
    path = scratch(spark, "download")
    sinks.to_csv(posts(spark, sf), path, ["record_id", "page_name"], mark=True)
    return readers.csv(spark, path, "record_id bigint, page_name string")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY left(text, 50)")
def s9_x6_incremental(spark, sf):
    """A file stream appended in two runs: the second brings only keys that are new."""
    from ..streaming.incremental import ingest

    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("post_id"), F.lit(None).cast("string").alias("post_url"), F.col("text").alias("post_content"))
    folder, target, state = (scratch(spark, x) for x in ("in", "out", "state"))
    first = distinct_first(d.withColumn("n", F.col("post_id").cast("bigint")).withColumn("k", F.substring("post_content", 1, 50)), ["k"], "n")
    for part in (first.drop("n", "k"), d):
        part.write.mode("append").json(folder)
        ingest(spark, folder, target, state).awaitTermination()
    return spark.read.parquet(target).select(F.col("post_id").cast("bigint").alias("doc_id"))


@query()
def s16_manifest(spark, sf):
    path = scratch(spark, "files")
    table(spark, sf, "region").write.parquet(path)
    return readers.manifest(spark, path)


def put_files(spark, rows, folder):
    """Files (``file``, ``value``) that the executors write, one row for each, under their names."""
    path = scratch(spark, "files")
    rows.write.partitionBy("file").option("maxRecordsPerFile", 1).option("lineSep", " ").text(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target)
    for name, *_ in readers.files(spark, path, r"/file=[^/]*/part-"):
        system.rename(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.hadoop.fs.Path(f"{folder}/{name.rsplit('/', 2)[-2].removeprefix('file=')}"))


#: Documents of one crawl file.
FILE_ROWS = 40
_FILES = f"""f AS (SELECT doc_id, md5(text) AS content, doc_id // {FILE_ROWS} AS g, row_number() OVER (PARTITION BY doc_id // {FILE_ROWS} ORDER BY doc_id) AS n, doc_id % 13 = 0 AS blank FROM documents),
k AS (SELECT *, CASE WHEN g % 4 = 3 THEN g || '.jsonl' WHEN g % 9 = 5 THEN g || '_comments.json' ELSE g || '.json' END AS file FROM f)"""


def crawl_folder(spark, sf):
    """Documents as crawl files: arrays and lines, some of them cut short, with a broken line, with entries that are no posts, or of comments."""
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / FILE_ROWS).alias("g"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("post_id"), F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text")).alias("post_content"))).alias("post"))
    files = d.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "post"))), lambda x: x["post"]).alias("posts"))
    g, lines = F.col("g"), F.col("g") % 4 == 3
    name = F.concat(g.cast("string"), F.when(lines, ".jsonl").when(g % 9 == 5, "_comments.json").otherwise(".json"))
    array = F.concat(F.lit("["), F.array_join("posts", ", "), F.lit("]"))
    whole = files.withColumn("a", array)
    text = F.when(g % 5 == 0, F.expr("substr(a, 1, length(a) - 2)")).when(g % 5 == 1, F.concat(F.lit('[7, "x", null, '), F.expr("substr(a, 2)"))).otherwise(F.col("a"))
    line = F.array_join(F.when(g % 8 == 7, F.concat(F.slice("posts", 1, 10), F.array(F.lit('{"post_id": ')), F.slice("posts", 11, FILE_ROWS))).otherwise(F.col("posts")), "\n")
    folder = scratch(spark, "crawl")
    put_files(spark, whole.select(name.alias("file"), F.when(lines, line).otherwise(text).alias("value")), folder)
    return folder


@query(f"WITH {_FILES} SELECT doc_id::VARCHAR AS post_id, content, file AS json_source FROM k WHERE NOT blank AND CASE WHEN g % 4 = 3 THEN g % 8 <> 7 OR n <= 10 ELSE g % 9 <> 5 AND g % 5 <> 0 END")
def s2_s3_crawl_folder(spark, sf):
    """Posts of JSON arrays and lines below one folder, comment files and what is broken left out."""
    return readers.crawled_posts(spark, crawl_folder(spark, sf)).select("post_id", F.md5("post_content").alias("content"), "json_source")


@query(f"""WITH {_FILES}, c AS (SELECT file, g, count(*) AS n FROM k GROUP BY ALL)
SELECT file, CASE WHEN g % 4 = 3 THEN 'broken line' ELSE 'invalid JSON' END AS reason, CASE WHEN g % 4 = 3 THEN greatest(n - 10, 0) + 1 ELSE 0 END AS n_lost FROM c WHERE CASE WHEN g % 4 = 3 THEN g % 8 = 7 ELSE g % 9 <> 5 AND g % 5 = 0 END""")
def s2_crawl_failures(spark, sf):
    """The files of the same folder that aren't whole, with the reason and the lines that were lost."""
    return readers.crawl(spark, crawl_folder(spark, sf))[1]


_DEALT = "s AS (SELECT doc_id, text, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM documents)"


def split_folder(spark, sf):
    """Documents as the three files of a scenario, with text columns of their own, among files that are none of them."""
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "record_id")
    folder, text = scratch(spark, "splits"), F.col("text")
    part = F.col("record_id") % 10
    for name, rows, columns in (
            ("a_train.csv", part < 7, ["text_nosw", "text_clean"]), ("val-1.csv", (part >= 7) & (part < 9), ["text_clean", "text"]), ("my.test.csv", part == 9, ["text", "text_clean"]), ("deep/train.csv", part == 0, ["text"]), ("latest.csv", part == 1, ["text"])):
        sinks.to_csv(d.where(rows).select("record_id", *[(F.lower(text) if c == "text_clean" else text).alias(c) for c in columns]), f"{folder}/{name}")
    return folder


@query(f"WITH {_DEALT} SELECT split, CASE split WHEN 'train' THEN 'a_train.csv' WHEN 'val' THEN 'val-1.csv' ELSE 'my.test.csv' END AS file, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM s GROUP BY split")
def s5_split_discovery(spark, sf):
    """The files that are found for each split, read."""
    out = None
    for split, path in readers.split_paths(spark, split_folder(spark, sf)).items():
        rows = readers.csv(spark, path, "record_id bigint").agg(F.count("*").alias("n"), F.sum("record_id").alias("ids")).select(F.lit(split).alias("split"), F.lit(path.rsplit("/", 1)[-1]).alias("file"), "n", "ids")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {_DEALT} SELECT split, doc_id AS record_id, 'text_clean' AS text_column, md5(lower(text)) AS text FROM s")
def f18_l10_text_column(spark, sf):
    """All rows of the splits with the first preferred text column that all of them have."""
    frames = {split: readers.csv(spark, path) for split, path in readers.split_paths(spark, split_folder(spark, sf)).items()}
    column = readers.text_column(list(frames.values()), ["text_nosw", "text_clean", "text"])
    out = None
    for split, rows in frames.items():
        rows = rows.select(F.lit(split).alias("split"), F.col("record_id").cast("bigint").alias("record_id"), F.lit(column).alias("text_column"), F.md5(column).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'Vui' || chr(32) || 'Vẻ' ELSE c_name END AS word, c_mktsegment AS one, c_nationkey::VARCHAR AS two FROM customer)
SELECT word, CASE WHEN k % 4 = 3 THEN NULL ELSE one END AS first, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END AS n_details FROM e WHERE k % 5 <> 0""")
def s6_tx12_dictionary(spark, sf):
    """A dictionary of customers' names in files of a bounded number of words, entries of all shapes; every fifth word is a standard one, which is left out."""
    k = F.col("c_custkey")
    word = F.when(k % 5 == 0, "Vui Vẻ").otherwise(F.col("c_name"))
    said = lambda c: F.struct(c.alias("word"))
    one, two = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    both = F.array(said(one), said(two))
    shapes = F.when(k % 4 == 0, F.to_json(F.struct(said(one).alias("normalized")))).when(k % 4 == 1, F.to_json(F.struct(both.alias("normalized")))).when(
        k % 4 == 2, F.to_json(F.create_map(F.lower(word), F.struct(F.array(said(two)).alias("normalized"))))).otherwise(F.to_json(F.array(F.struct(said(one).alias("normalized")), F.struct(said(two).alias("normalized")))))
    normal = F.to_json(F.when(k % 4 == 3, F.expr("cast(array() as array<string>)")).otherwise(F.array(one)))
    entry = F.concat(F.to_json(F.array(word)), F.lit(": {\"normalized\": "), normal, F.lit(", \"response\": "), shapes, F.lit("}"))
    rows = table(spark, sf, "customer").select(F.floor(k / 500).alias("g"), F.regexp_replace(entry, r'^\["(.*?)"\]:', '"$1":').alias("entry"))
    files = rows.groupBy("g").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("entry"), ", "), F.lit("}")).alias("value"))
    folder = scratch(spark, "dictionary")
    put_files(spark, files.select(F.concat(F.col("g").cast("string"), F.lit(".json")).alias("file"), "value"), folder)
    return readers.dictionary(spark, folder).select("word", F.get("candidates", F.lit(0)).alias("first"), F.size("details").alias("n_details"))


@query(f"WITH {PREDICTIONS} SELECT record_id::VARCHAR AS record_id, y_true, y_pred, 'S1' AS scenario, 'M1' AS model_name, 'val' AS split FROM p WHERE scenario = 'S1' AND model_name = 'M1' AND split = 'val'")
def s18_load_predictions(spark, sf):
    """Prediction files of two splits, one of which is missing, tagged and put together."""
    base = scratch(spark, "predictions")
    rows = predictions(spark, sf).where("scenario = 'S1' and model_name = 'M1' and split = 'val'")
    sinks.to_csv(rows, f"{base}/S1/M1/predictions_val.csv", ["record_id", "y_true", "y_pred", "confidence"])
    both = [readers.predictions(spark, base, "S1", "M1", s) for s in ("val", "test")]
    return both[0].unionByName(both[1]).drop("confidence")
