"""Language-model scoring by cross-entropy difference.

A target model (of chosen documents) and a background model (of all documents) are n-gram models of the same order and
smoothing over one shared, open vocabulary: every character of the whole corpus (and a start sign, and one sign for characters that only
other documents have). A document's score is its loss per token under the target model less that under the background model: low is target-like.

Both vocabulary and counts are gathered from every document into distributed tables keyed by n-gram, one for each order, which grow with
the n-grams that the corpus has. Losses of the most frequent n-grams, as many as may be broadcast, are added up where a document is read;
those of all others are joined to it by n-gram.

N-grams have five tokens, whatever the corpus. The SINGLE most frequent characters are a token each; every other character is two, so that all of Unicode has
some five thousand tokens, and five of them a number of 62 bits. Losses are per token.

Defined results: null and empty texts have no tokens and null losses and score; repeated rows get equal results and count as often as they occur; with no target
document the target model is uniform; of equally frequent characters the least code point is numbered first, which changes no result; very long texts are read whole, in pieces;
extra columns are left out; empty tables give empty results. Only doc_id and text are read, and the target flag.
"""

from __future__ import annotations

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import bounded, clean_of, materialize, text_key
from .linear import LABEL_ROWS

cloudpickle.register_pickle_by_value(grams)

ORDER, STRENGTH = 5, 5.0
#: N-grams whose losses may be broadcast.
SHARED_GRAMS = 1 << 20
#: Characters that are one token, the most frequent ones; others are one of PAIR first tokens and one of PAIR second ones, at most.
SINGLE, PAIR = 3072, 1056


def train(docs: DataFrame, size: int | None = None, order: int = ORDER):
    """(vocabulary table, tokens, levels, n-grams). docs: text and target (whether the document is of the target).

    size: only so many of the most frequent characters; all by default. levels: of each order, from 1 up, the counts of
    its n-grams and those of their contexts. n-grams: cell, target, background counts.
    """
    rows = docs.select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = rows.select("text").mapInArrow(grams.char_counts, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    ranked = counts.orderBy(F.col("n").desc(), "code")
    # there are 0x110000 code points at most
    common = (ranked if size is None else ranked.limit(size)).select("code").toArrow()["code"].to_numpy()
    table = np.ones(max(127, common.max(initial=0)) + 2, np.int32)
    table[common[:SINGLE]] = np.arange(2, len(common[:SINGLE]) + 2)
    rare = np.arange(len(common[SINGLE:]))
    first = 2 + len(common[:SINGLE])
    second = first + -(-len(rare) // PAIR)
    table[common[SINGLE:]] = -((first + rare // PAIR) << 13 | (second + rare % PAIR))  # two tokens, see grams.spelled()
    tokens = second + min(PAIR, len(rare))
    cells = rows.mapInArrow(grams.gram_counts(table, tokens, order), "cell bigint, target bigint, background bigint")
    cells = materialize(summed(cells, F.col("cell")).withColumnRenamed("gram", "cell"), "grams")
    levels = []
    for n in range(1, order + 1):
        level = summed(cells, F.col("cell") % tokens**n)
        level = materialize(level, "level") if n < order else cells.withColumnRenamed("cell", "gram")
        levels.append((level, materialize(summed(level, F.expr(f"gram div {tokens}")), "contexts")))
    return table, tokens, levels, cells


def summed(counts: DataFrame, key) -> DataFrame:
    return counts.groupBy(key.alias("gram")).agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def priced(cells: DataFrame, tokens: int, levels) -> DataFrame:
    """cells with target_loss and background_loss, -log p(last token | those before), by interpolation to lower orders; n-grams never counted too."""
    names = ("target", "background")
    p = {}
    for n, (level, contexts) in enumerate(levels, 1):
        # one context of order 1, and as many n-grams of order 1 and contexts of order 2 as there are tokens: a few thousand, one of them in every row
        if n == 1:
            level = F.broadcast(level)
        if n <= 2:
            contexts = F.broadcast(contexts)
        own = level.select(F.col("gram").alias("__g"), *[F.col(x).alias(f"__c_{x}") for x in names])
        context = contexts.select(F.col("gram").alias("__o"), *[F.col(x).alias(f"__t_{x}") for x in names])
        gram = F.col("cell") % tokens**n
        cells = cells.withColumn("__gram", gram).withColumn("__context", F.expr(f"__gram div {tokens}"))
        cells = cells.join(own, F.col("__gram") == F.col("__g"), "left").join(context, F.col("__context") == F.col("__o"), "left")
        for x in names:
            c, t = F.coalesce(f"__c_{x}", F.lit(0)), F.coalesce(f"__t_{x}", F.lit(0))
            p[x] = (c + 1.0) / (t + tokens) if n == 1 else (c + STRENGTH * F.col(f"__p_{x}")) / (t + STRENGTH)
        cells = cells.withColumns({f"__p_{x}": p[x] for x in names}).drop("__g", "__o", "__gram", "__context", *[f"__{k}_{x}" for k in "ct" for x in names])
    return cells.withColumns({f"{x}_loss": -F.log(f"__p_{x}") for x in names}).drop(*[f"__p_{x}" for x in names])


def score(docs: DataFrame, model, counted: bool = False) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score: one row for each input row. counted: the model is of these documents."""
    table, tokens, levels, cells = model
    order = len(levels)
    rows = clean_of(docs, "doc_id", "text").select("doc_id", text_key(F.col("text")).alias("h"), "text")
    if not counted:
        own = rows.select("text", F.lit(False).alias("target")).mapInArrow(grams.gram_counts(table, tokens, order), "cell bigint, target bigint, background bigint")
        cells = summed(own, F.col("cell")).withColumnRenamed("gram", "cell")
    losses = materialize(priced(cells.select("cell", F.col("background").alias("times")), tokens, levels), "losses")
    whole = losses.count() <= SHARED_GRAMS
    first = (losses if whole else losses.orderBy(F.col("times").desc(), "cell").limit(SHARED_GRAMS)).select("cell", "target_loss", "background_loss").toArrow()
    keys = first["cell"].to_numpy()
    at = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[at], *[first[f"{x}_loss"].to_numpy()[at].astype(np.float32) for x in ("target", "background")]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sums = rows.mapInArrow(grams.lm_scorer(table, tokens, order, shared), f"doc_id {kind}, h bigint, n bigint, x double, y double, cells array<bigint>, times array<bigint>")
    if not whole:
        sums = with_rest(materialize(sums, "sums"), losses)
    sums = sums.withColumns({"target_loss": F.when(F.col("n") > 0, F.col("x") / F.col("n")), "background_loss": F.when(F.col("n") > 0, F.col("y") / F.col("n"))})
    return sums.select("doc_id", F.col("n").alias("n_tokens"), "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))


def with_rest(sums: DataFrame, losses: DataFrame) -> DataFrame:
    """doc_id, n, x, y of each row, the losses of its cells outside the broadcast added."""
    rest = sums.where(F.size("cells") > 0).select("doc_id", "h", F.explode(F.arrays_zip("cells", "times")).alias("z")).select("doc_id", "h", F.col("z.cells").alias("cell"), F.col("z.times").alias("m"))
    rest = rest.join(losses.select("cell", "target_loss", "background_loss"), "cell")
    # losses as the broadcast has them, so that a cell's loss doesn't depend on its way
    rest = rest.select("doc_id", "h", F.lit(0).cast("bigint").alias("n"), *[(F.col("m") * F.col(f"{k}_loss").cast("float").cast("double")).alias(x) for x, k in (("x", "target"), ("y", "background"))], F.lit(0).cast("bigint").alias("rows"))
    by_row = sums.select("doc_id", "h", "n", "x", "y", F.lit(1).cast("bigint").alias("rows")).unionByName(rest).groupBy("doc_id", "h").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "rows")])
    # repeated rows have met here and leave one by one
    return by_row.select("doc_id", *[(F.col(c) / F.col("rows")).cast("bigint" if c == "n" else "double").alias(c) for c in "nxy"], F.explode(F.sequence(F.lit(1).cast("bigint"), "rows"))).drop("col")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents; those labelled as of good quality are the target."""
    good = clean_of(labels, "doc_id", "quality").where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("of_doc"), F.lit(True).alias("target")).distinct()
    flagged = clean_of(docs, "doc_id", "text").join(bounded(good, good.count(), LABEL_ROWS), F.col("doc_id") == F.col("of_doc"), "left").select("text", "target")
    return score(docs, train(flagged), counted=True)
