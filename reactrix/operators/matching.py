"""Joins of labelled text with crawled posts: exact by normalised text, then fuzzy by character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_key
from .ranges import stored
from .ranking import distinct_first


def exact_match(left: DataFrame, right: DataFrame, left_text: str, right_text: str) -> DataFrame:
    """Inner join on the match key; equal keys on both sides multiply, empty keys match each other."""
    return left.withColumn("match_key", match_key(left_text)).join(right.withColumn("match_key", match_key(right_text)), "match_key")


def exact_groups(left: DataFrame, right: DataFrame, left_text: str, right_text: str, right_id: str) -> DataFrame:
    """left with the least right_id of equal match key and n, how many there are: exact_match() with the right side as classes, so that copies don't multiply.

    Right rows are counted before the join, which is on a digest of the key.
    """
    classes = right.groupBy(F.md5(match_key(right_text)).alias("__key")).agg(F.min(right_id).alias(right_id), F.count("*").alias("n"))
    return left.withColumn("__key", F.md5(match_key(left_text))).join(classes, "__key").drop("__key")


def exact_match_once(left: DataFrame, right: DataFrame, left_text: str, right_text: str, right_order: str) -> DataFrame:
    """As exact_match, with one right row for each key and no empty keys."""
    key = F.md5("match_key")  # texts themselves aren't shuffled by
    right = distinct_first(right.withColumn("match_key", match_key(right_text)).where("match_key <> ''").withColumn("__key", key), ["__key"], right_order).drop("match_key")
    return left.withColumn("match_key", match_key(left_text)).withColumn("__key", key).join(right, "__key").drop("__key")


def word_grams(key: Column, low: int, high: int) -> Column:
    """Character n-grams of the key as one word with a blank at both ends, repeats included."""
    padded = F.concat(F.lit(" "), key, F.lit(" "))

    def of_length(p, k):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - k + 1))
        return F.when(F.length(p) >= k, F.transform(starts, lambda i: F.substring(p, i, F.lit(k)))).otherwise(F.expr("cast(array() as array<string>)"))

    bound = F.transform(F.array(padded), lambda p: F.flatten(F.array(*[of_length(p, k) for k in range(low, high + 1)])))
    return F.element_at(bound, 1)


def tfidf(docs: DataFrame, id_col: str, grams: Column, fitted: DataFrame | None = None, sublinear: bool = False) -> tuple[DataFrame, DataFrame]:
    """((id, gram, weight) with unit rows, (gram, idf)): smoothed idf + 1, rows scaled to length 1.

    fitted: the idf table of another set; grams that it lacks go before the rows are scaled.
    """
    terms = docs.select(F.col(id_col), F.explode(grams).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias("tf"))
    if fitted is None:
        n = docs.count()
        fitted = terms.groupBy("gram").agg((F.log((1.0 + F.lit(n)) / (1.0 + F.count("*"))) + 1).alias("idf"))
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = terms.join(fitted, "gram").select("*", (tf * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, *fitted.columns, (F.col("w") / norm).alias("weight")), fitted


def fuzzy_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str, right_text: str, threshold: float = 0.85, low: int = 2, high: int = 4) -> DataFrame:
    """(left_id, right_id, similarity): each left row's most similar right row, if above the threshold.

    Candidates must share a gram of their rarest: with unit rows and grams in one order of document frequency, the
    grams after which the rest of a row's length is below the threshold can't lift a pair above it. Where both prefixes,
    the grams before that point, have none in common, all that a pair shares is in the rest of the row whose prefix
    ends first, so only prefixes are joined; the pairs found are then scored in full.
    Rows of equal text are scored once, under a digest of the text. Ties go to the least right_id.
    """
    lk = left.select(F.col(left_id).alias("l"), match_key(left_text).alias("text")).where("text <> ''").withColumn("t", F.md5("text"))
    rk = right.select(F.col(right_id).alias("r"), match_key(right_text).alias("text")).where("text <> ''").withColumn("rk", F.md5("text"))
    rk = rk.groupBy("rk").agg(F.min("r").alias("r"), F.first("text").alias("text"))
    texts = lk.groupBy("t").agg(F.first("text").alias("text"))
    grams = word_grams(F.col("text"), low, high)
    b, idf = tfidf(rk, "rk", grams)
    a, b = stored(tfidf(texts, "t", grams, idf)[0], "left_weights"), stored(b, "right_weights")

    def prefix(rows, key):
        rare = Window.partitionBy(key).orderBy(F.col("idf").desc(), "gram").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        rest = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(rare))
        return rows.withColumn("rest", rest).where(F.col("rest") > threshold - 1e-9).select(key, "gram")

    pairs = prefix(a, "t").join(prefix(b, "rk"), "gram").select("t", "rk").distinct()
    scored = pairs.join(a.select("t", "gram", F.col("weight").alias("wa")), "t").join(b.select("rk", "gram", F.col("weight").alias("wb")), ["rk", "gram"]).groupBy("t", "rk").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity")).where(F.col("similarity") > threshold)
    best = scored.join(rk.select("rk", "r"), "rk").withColumn("n", F.row_number().over(Window.partitionBy("t").orderBy(F.round("similarity", 9).desc(), "r"))).where("n = 1")
    return lk.join(best, "t").select(F.col("l").alias(left_id), F.col("r").alias(f"match_{right_id}"), "similarity")


def drop_rate(left: DataFrame, right_keys: DataFrame, key: str, label: str) -> DataFrame:
    """label, n, n_dropped, drop_rate: left rows without a partner."""
    keys = right_keys.select(F.col(key).alias("__k")).distinct()
    return left.join(keys, F.col(key) == F.col("__k"), "left").groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col("__k").isNull()).alias("n_dropped"), F.avg(F.col("__k").isNull().cast("int")).alias("drop_rate"))
