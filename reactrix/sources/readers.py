"""Readers of labelled tables, crawled posts, dictionaries, splits and predictions. All paths go through Spark's file systems."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranges import stored

LABELLED = "post_id string, content string, label_from_content string, comment_ids string"
CRAWLED = ("post_url string, post_id string, feedback_id string, post_content string, creation_time bigint, share_count bigint, comment_count bigint, "
           "reactions_detail map<string,bigint>, total_reactions bigint, page_name string, page_followers bigint")
SPLITS = ("train", "val", "test")


def unmarked(df: DataFrame) -> DataFrame:
    """Without a byte order mark before the first column's name."""
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def csv(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """Header CSV with quoted line breaks; columns are found by name, missing ones are null."""
    raw = unmarked(spark.read.csv(paths, header=True, multiLine=True, escape='"', encoding="UTF-8"))
    if schema is None:
        return raw
    wanted = T._parse_datatype_string(schema)
    return raw.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def labelled_posts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Posts of all files: one row for each content (the first by post_id), then rows with comment ids, which are posts."""
    from ..operators.ranking import distinct_first

    rows = distinct_first(csv(spark, paths, LABELLED), ["content"], "post_id")
    return rows.where(F.col("comment_ids").isNotNull()).drop("comment_ids")


def crawl(spark: SparkSession, folder: str, skip: str = "comments.json") -> tuple[DataFrame, DataFrame]:
    """(posts, failures) of all .json files (one array each) and .jsonl files below a folder; names that contain ``skip`` are left out.

    posts: CRAWLED and json_source, of records with content. failures: file, reason, n_lost (records, 0 where they can't be told), a row for each file that
    isn't whole. An array that can't be parsed gives no posts; lines are taken up to the first broken one; blank lines say nothing. What isn't an object
    in an array is passed over. One bad file never hides another: both tables come from one parse, which executors do and store.
    """
    wanted = [f for f, *_ in files(spark, folder) if skip not in f.rsplit("/", 1)[-1]]
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    kinds = []
    if arrays := [f for f in wanted if f.endswith(".json")]:
        raw = spark.read.text(arrays, wholetext=True).select(name.alias("file"), "value", F.json_array_length("value").alias("n"), F.col("value").rlike(r"\]\s*$").alias("closed"))
        fine = F.col("n").isNotNull() & F.col("closed")
        reason = F.when(F.json_object_keys("value").isNotNull(), "not an array").when(~fine, "invalid JSON")
        whole = F.when(fine & (F.col("n") > 0), F.from_json("value", "array<string>"))
        kinds.append(raw.select("file", reason.alias("reason"), F.posexplode_outer(whole).alias("n", "record"), F.lit(0).cast("bigint").alias("start"), F.lit(False).alias("line")).withColumn("n", F.col("n").cast("bigint")))
    if lines := [f for f in wanted if f.endswith(".jsonl")]:
        # places rise inside a split, and splits by their start
        raw = spark.read.text(lines).select(name.alias("file"), "value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).where(F.col("value").rlike(r"\S"))
        kinds.append(raw.select("file", F.when(F.json_object_keys("value").isNull(), "broken line").alias("reason"), "n", F.col("value").alias("record"), "start", F.lit(True).alias("line")))
    if not kinds:
        return spark.createDataFrame([], CRAWLED + ", json_source string"), spark.createDataFrame([], "file string, reason string, n_lost bigint")
    parsed = kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])
    parsed = stored(parsed.withColumn("post", F.when(F.json_object_keys("record").isNotNull(), F.from_json("record", CRAWLED))), "crawl")
    place = F.struct("start", "n")
    failed = stored(parsed.where(F.col("reason").isNotNull()).groupBy("file").agg(F.min(F.struct(place.alias("at"), "reason")).alias("x")).select("file", "x.at", "x.reason"), "failed")
    met = parsed.drop("reason").join(failed.select("file", "at"), "file", "left")  # files that failed
    posts = met.where((F.col("at").isNull() | (F.col("line") & (place < F.col("at")))) & (F.col("post.post_content") != "")).select("post.*", F.col("file").alias("json_source"))
    lost = met.where(F.col("line") & (place >= F.col("at"))).groupBy("file").agg(F.count("*").alias("n_lost"))
    return posts, failed.join(lost, "file", "left").select("file", "reason", F.coalesce("n_lost", F.lit(0)).alias("n_lost"))


def crawled_posts(spark: SparkSession, folder: str, skip: str = "comments.json") -> DataFrame:
    return crawl(spark, folder, skip)[0]


def files(spark: SparkSession, folder: str, pattern: str = ".*") -> list[tuple[str, int, int]]:
    """(path, bytes, modified ms) of the files below a folder, in path order. A listing of names, never of contents."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, walk = [], system.listFiles(root, True)
    while walk.hasNext():
        f = walk.next()
        path = f.getPath().toString()
        if re.search(pattern, path):
            out.append((path, f.getLen(), f.getModificationTime()))
    return sorted(out)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, bytes, modified of every file below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def split_paths(spark: SparkSession, folder: str) -> dict[str, str]:
    """The shallowest file of each split, told by its stem; an error if one of the three is missing."""
    found: dict[str, str] = {}
    # a folder of part files is one file
    paths = {re.sub(r"(\.\w+)/(part-|_)[^/]*$", r"\1", f) for f, *_ in files(spark, folder)}
    for path in sorted(paths, key=lambda f: (f.count("/"), f)):
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
        for s in SPLITS:
            if re.search(rf"(^|[_\-.]){s}([_\-.]|$)", stem):
                found.setdefault(s, path)
    if missing := [s for s in SPLITS if s not in found]:
        raise FileNotFoundError(f"{folder}: no file for {', '.join(missing)}")
    return found


def text_column(frames: list[DataFrame], preferred: list[str]) -> str:
    """The first preferred column that all frames have."""
    common = set.intersection(*[set(f.columns) for f in frames])
    for c in preferred:
        if c in common:
            return c
    raise ValueError(f"none of {preferred} is in all frames")


# Standard words that the dictionary normalises wrongly and that are left out of it.
STANDARD_WORDS = [
    "là", "trong", "khi", "nam", "an", "làm", "sau", "gia", "nhân", "thể", "đầu", "hà", "trung", "đang", "định", "còn", "quan", "nhưng", "hàng", "qua",
    "điều", "tuổi", "lên", "viên", "đường", "thực", "giá", "đây", "tự", "minh", "thì", "lực", "nay", "do", "bà", "tới", "ai", "ăn", "tịch", "sử", "thương",
    "nên", "phương", "thu", "chị", "ý", "quy", "chiến", "vi", "bất", "kỳ", "pháp", "mang", "giả", "giữ", "ngay", "trai", "quyết", "vị", "diện", "danh",
    "ban", "gì", "đặc", "sở", "khác", "cái", "tối", "thi", "trang", "tra", "kiến", "mở", "biểu", "cá", "chuyên", "chi", "dài", "tư", "hải", "tìm", "mắt",
    "đàn", "thay", "nhiệm", "cuối", "mức", "chế", "đẹp", "nghỉ", "yêu", "nhiều", "lần", "mới", "hiểu", "ra", "được", "dưới", "khuyên", "có", "hơi", "phũ",
    "chạm", "lòng", "ngã", "tôi", "hoặc", "quanh", "ngày", "đêm", "học", "sinh", "chết", "con", "mẹ", "thế", "này", "kia", "sao", "cho", "với", "về", "đã",
    "mọi", "thứ", "cuộc", "sống", "người", "bạn", "xung", "quanh", "đều", "phũ phàng", "tự ái", "bè", "dây", "tử", "những", "xứng", "chó", "chú", "chúa",
    "chút", "chưa", "chờ", "chơi", "bình thường", "vui vẻ", "vui",
]


def dictionary(spark: SparkSession, path: str, blacklist: list[str] = STANDARD_WORDS) -> DataFrame:
    """word, candidates, details of a JSON map, or of all files of a folder, without blacklisted words (compared in lower case).

    details are read from either of the shapes that entries have: a response with one or more ``normalized`` records, the same
    below the word itself, or a list of such responses.
    """
    entry = "map<string,struct<normalized:array<string>,response:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entry)).alias("word", "entry"))
    r = F.col("entry.response")
    record = "map<string,string>"
    one = lambda p: F.when(F.get_json_object(r, p).startswith("{"), F.array(F.from_json(F.get_json_object(r, p), record)))
    many = lambda p: F.when(F.get_json_object(r, p).startswith("["), F.from_json(F.get_json_object(r, p), f"array<{record}>"))
    nested = F.from_json(r, "map<string,struct<normalized:string>>")
    inner = F.try_element_at(nested, F.lower("word"))["normalized"]
    own = F.when(inner.startswith("["), F.from_json(inner, f"array<{record}>")).when(inner.startswith("{"), F.array(F.from_json(inner, record)))
    listed = F.when(r.startswith("["), F.flatten(F.transform(F.from_json(r, "array<struct<normalized:string>>"), lambda x: F.when(x["normalized"].startswith("["), F.from_json(x["normalized"], f"array<{record}>")).when(x["normalized"].startswith("{"), F.array(F.from_json(x["normalized"], record))).otherwise(F.expr(f"cast(array() as array<{record}>)")))))
    details = F.coalesce(listed, one("$.normalized"), many("$.normalized"), own, F.expr(f"cast(array() as array<{record}>)"))
    words = raw.select("word", F.coalesce("entry.normalized", F.expr("cast(array() as array<string>)")).alias("candidates"), details.alias("details"))
    return words.where(~F.lower("word").isin([b.lower() for b in blacklist])) if blacklist else words


def predictions(spark: SparkSession, base: str, scenario: str, model: str, split: str) -> DataFrame:
    """A prediction file tagged with what it is of; empty if there is none."""
    schema = "record_id string, y_true string, y_pred string, confidence double"
    found = files(spark, base, rf"/{re.escape(scenario)}/{re.escape(model)}/predictions_{re.escape(split)}\.csv(/part-[^/]*)?$") if exists(spark, base) else []
    rows = csv(spark, [f for f, *_ in found], schema) if found else spark.createDataFrame([], schema)
    return rows.withColumns({"scenario": F.lit(scenario), "model_name": F.lit(model), "split": F.lit(split)})


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, raw: str, compute, fresh: bool = False) -> DataFrame:
    """The Parquet table at path, made by compute(raw) if it is asked for or missing; the old one serves if raw is missing."""
    if (fresh or not exists(spark, path)) and exists(spark, raw):
        compute(raw).write.mode("overwrite").parquet(path)
    if not exists(spark, path):
        raise FileNotFoundError(f"neither {path} nor {raw} is there")
    return spark.read.parquet(path)
