"""Keyphrases of a set of captions: frequent word n-grams that aren't in nearly all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = [
    "và", "là", "của", "các", "có", "trong", "để", "với", "một",
    "không", "những", "cho", "người", "khi", "này", "đã", "từ",
    "rằng", "đến", "thì", "mà", "bị", "được", "như", "trên", "tại", "vào",
]


def word_ngrams(text: Column, low: int, high: int, stopwords: list[str]) -> Column:
    """Lower-case words of two characters or more, without stopwords, joined to n-grams."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(stopwords)) if stopwords else words

    def of_length(w, n):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1))
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))

    # the words are bound once, as a lambda variable
    bound = F.transform(F.array(kept), lambda w: F.flatten(F.array(*[of_length(w, n) for n in range(low, high + 1)])))
    return F.element_at(bound, 1)


def phrase_counts(captions: DataFrame, text: str, low: int, high: int, min_df: int, max_df: float, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """phrase, n, df. A caption gives each phrase as often as it has it, the first time marked for df; both are summed map-side."""
    kept = captions.where(F.length(text) > 3)
    n_docs = kept.count()
    grams = kept.select(word_ngrams(F.col(text), low, high, stopwords).alias("g"))
    # equal phrases of a caption stand side by side once it is sorted; the sorted list is bound once, as a lambda variable
    marks = F.flatten(F.transform(F.array(F.sort_array("g")), lambda g: F.transform(g, lambda x, i: F.struct(x.alias("phrase"), (~x.eqNullSafe(F.get(g, i - 1))).alias("first")))))
    counts = grams.select(F.explode(marks).alias("m")).groupBy("m.phrase").agg(F.count("*").alias("n"), F.count_if("m.first").alias("df"))
    return counts.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))


def keyphrases(captions: DataFrame, text: str, k: int = 6) -> DataFrame:
    """The k most frequent 2- and 3-grams found in two captions or more; where there are none, 1- and 2-grams of any."""
    def top(counts):
        return counts.orderBy(F.col("n").desc(), "phrase").limit(k)

    first = top(phrase_counts(captions, text, 2, 3, 2, 0.9))
    rows = first.collect()  # k rows, so that the counts are made once
    return captions.sparkSession.createDataFrame(rows, first.schema) if rows else top(phrase_counts(captions, text, 1, 2, 1, 0.9))
