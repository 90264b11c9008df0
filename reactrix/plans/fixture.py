"""The fixed mapping of driver tables to posts, predictions and trials, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import REACTIONS, enrich


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post for each order that has items. Items are summed by order before the join, so only sums are joined."""
    item = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *[F.coalesce(F.sum(F.when(F.col("l_linenumber") == k + 1, F.col("l_quantity"))), F.lit(0.0)).cast("bigint").alias(f"{r}_count") for k, r in enumerate(REACTIONS)],
        F.sum("l_quantity").cast("bigint").alias("total_reactions"), F.count("*").alias("comment_count"), F.count_if(F.col("l_returnflag") == "R").alias("share_count"))
    key = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders").join(item, key == F.col("l_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("record_id"), F.col("o_orderpriority").alias("topic_label_final"), F.col("n_name").alias("page_name"), F.to_date("o_orderdate").alias("parsed_date"),
            *[f"{r}_count" for r in REACTIONS], "total_reactions", "comment_count", "share_count",
            (F.col("n_nationkey").cast("bigint") * 1000).alias("page_followers"), (F.col("n_nationkey") % 5 != 0).cast("int").alias("has_page_followers"),
            F.when(key % 50 != 0, (key % 24).cast("int")).alias("post_created_hour"), F.date_format("o_orderdate", "EEEE").alias("post_created_weekday"),
            (key % 10 != 0).cast("int").alias("usable_for_reaction_analysis"), (key % 25 != 0).cast("int").alias("usable_for_engagement_analysis_strict"))
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(posts(spark, sf_dir))


def reaction_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts eligible for reaction analysis."""
    return enriched(spark, sf_dir).where("usable_for_reaction_analysis = 1 and total_reactions >= 10")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    guess = F.when(v % 7 == 0, (F.col("label") * 3 + v) % 10).otherwise(F.col("label"))
    code = lambda x: F.concat(F.lit("T"), F.lpad((x + 1).cast("string"), 2, "0"))
    return table(spark, sf_dir, "embeddings").select(
        v.alias("record_id"), code(F.col("label")).alias("y_true"), code(guess).alias("y_pred"), F.concat(F.lit("S"), v % 5).alias("scenario"),
        F.concat(F.lit("M"), v % 4).alias("model_name"), F.when(v % 3 == 0, "test").otherwise("val").alias("split"), ((v * 37 % 101) / 101.0).alias("confidence"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("trial_id"), F.concat(F.lit("S"), k % 5).alias("scenario"), F.concat(F.lit("M"), F.floor(k / 5) % 4).alias("model_name"),
        F.when(k % 11 != 0, (k * 7919 % 1000) / 1000.0).alias("macro_f1_val"), ((k * 104729 % 997) / 997.0).alias("weighted_f1_val"), ((k * 31 % 89) / 89.0).alias("accuracy_val"),
        ((k * 13 % 57) / 3.0).alias("train_time_sec"), F.when(k % 17 == 0, "failed").otherwise("success").alias("status"), ((k % 4 + 1) * 5000).alias("max_features"), (k % 3 + 1).cast("bigint").alias("ngram_max"),
        F.when(k % 2 == 0, "word").otherwise("char_wb").alias("analyzer"), F.when(k % 3 == 0, (k % 7) / 2.0).alias("c"), F.when(k % 3 == 1, (k % 5 * 100).cast("double")).alias("n_estimators"))


_SUMS = ",\n  ".join(f"coalesce(sum(l_quantity) FILTER (WHERE l_linenumber = {k + 1}), 0)::BIGINT AS {r}_count" for k, r in enumerate(REACTIONS))
POSTS = f"""items AS (SELECT l_orderkey, {_SUMS},
  sum(l_quantity)::BIGINT AS total_reactions, count(*) AS comment_count, count(*) FILTER (WHERE l_returnflag = 'R') AS share_count
  FROM lineitem GROUP BY l_orderkey),
posts AS (SELECT o_orderkey AS record_id, o_orderpriority AS topic_label_final, n_name AS page_name, o_orderdate::DATE AS parsed_date, items.* EXCLUDE (l_orderkey),
  n_nationkey::BIGINT * 1000 AS page_followers, (n_nationkey % 5 <> 0)::INT AS has_page_followers,
  CASE WHEN o_orderkey % 50 <> 0 THEN (o_orderkey % 24)::INT END AS post_created_hour, dayname(o_orderdate) AS post_created_weekday,
  (o_orderkey % 10 <> 0)::INT AS usable_for_reaction_analysis, (o_orderkey % 25 <> 0)::INT AS usable_for_engagement_analysis_strict
  FROM orders JOIN items ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_RATIOS = ", ".join(f"{r}_count / (CASE WHEN total_reactions > 0 THEN total_reactions ELSE 1 END)::DOUBLE AS {r}_ratio" for r in REACTIONS if r != "like")
_FOLLOWED = ", ".join(f"CASE WHEN has_page_followers = 1 AND page_followers > 0 THEN ({x}) / page_followers::DOUBLE ELSE 0 END AS {a}" for a, x in (
    ("reactions_per_follower", "total_reactions"), ("rel_spread", "share_count"), ("rel_discussion", "comment_count"), ("rel_like", "like_count"), ("engagement_per_follower", "total_reactions + comment_count + share_count")))
_ENOUGH = ", ".join(f"CASE WHEN total_reactions >= 10 THEN ({x}) / total_reactions::DOUBLE ELSE 0 END AS {a}" for a, x in (
    ("approval", "like_count + love_count"), ("outrage", "angry_count"), ("amusement", "haha_count"), ("empathy", "sad_count + care_count")))
ENRICHED = f"""{POSTS},
e1 AS (SELECT *, love_count + care_count AS pos_react, angry_count + sad_count + haha_count + wow_count AS neg_react FROM posts),
e2 AS (SELECT *, CASE WHEN pos_react + neg_react + like_count > 0 THEN (pos_react + neg_react)::DOUBLE / (pos_react + neg_react + like_count) END AS intensity,
  CASE WHEN pos_react + neg_react > 0 THEN sign(pos_react - neg_react)::DOUBLE END AS valence FROM e1),
e AS (SELECT *, intensity * valence AS polarity_sign,
  coalesce(intensity, 0) * (love_count + care_count - angry_count - sad_count) / (love_count + care_count + angry_count + sad_count + 5 + 1e-9) AS polarity_laplace,
  total_reactions + comment_count + share_count AS engagement_total, {_RATIOS}, {_ENOUGH}, {_FOLLOWED},
  (least(pos_react, angry_count)::DOUBLE / (greatest(pos_react, angry_count) + 1)) * (comment_count::DOUBLE / (comment_count + total_reactions + 1)) * log10(comment_count + share_count + total_reactions + 1) AS controversy,
  (haha_count + wow_count)::DOUBLE / (total_reactions + 1) AS sarcasm FROM e2),
r AS (SELECT * FROM e WHERE usable_for_reaction_analysis = 1 AND total_reactions >= 10)"""
PREDICTIONS = """p AS (SELECT vec_id AS record_id, 'T' || lpad((label + 1)::VARCHAR, 2, '0') AS y_true,
  'T' || lpad(((CASE WHEN vec_id % 7 = 0 THEN (label * 3 + vec_id) % 10 ELSE label END) + 1)::VARCHAR, 2, '0') AS y_pred,
  'S' || (vec_id % 5) AS scenario, 'M' || (vec_id % 4) AS model_name, CASE WHEN vec_id % 3 = 0 THEN 'test' ELSE 'val' END AS split, (vec_id * 37 % 101) / 101.0::DOUBLE AS confidence FROM embeddings)"""
TRIALS = """t AS (SELECT p_partkey AS trial_id, 'S' || (p_partkey % 5) AS scenario, 'M' || ((p_partkey // 5) % 4) AS model_name,
  CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 7919 % 1000) / 1000.0::DOUBLE END AS macro_f1_val, (p_partkey * 104729 % 997) / 997.0::DOUBLE AS weighted_f1_val, (p_partkey * 31 % 89) / 89.0::DOUBLE AS accuracy_val,
  (p_partkey * 13 % 57) / 3.0::DOUBLE AS train_time_sec, CASE WHEN p_partkey % 17 = 0 THEN 'failed' ELSE 'success' END AS status, (p_partkey % 4 + 1) * 5000 AS max_features, p_partkey % 3 + 1 AS ngram_max,
  CASE WHEN p_partkey % 2 = 0 THEN 'word' ELSE 'char_wb' END AS analyzer, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 7) / 2.0::DOUBLE END AS c, CASE WHEN p_partkey % 3 = 1 THEN (p_partkey % 5 * 100)::DOUBLE END AS n_estimators FROM part)"""
