"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one failure bit per rule. A policy is a
versioned mask of bits: a document is kept if no bit of the mask is set. Policies and ablations read the ledger, never
the texts again.

Repeated windows are found inside the row: hashes of all word windows are sorted with their places and equal neighbours
marked, so the cost is that of a sort of the row's own words and there is no shuffle.

Defined results: null text has no words, no lines and fails the rule of few words; repeated rows get equal results; an empty
table gives an empty ledger. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, split_words

#: Rule names in bit order: rule k sets bit 1 << k. Append only, so that stored ledgers keep their meaning.
RULES = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words"),
    "capitals": lambda: 2 * F.col("n_capitals") > F.col("n_ascii_letters"),
    "duplicate_lines": lambda: (F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Versioned policies.
POLICIES = {"base": mask("few_words", "repeated_windows"), "v1": mask(*RULES)}


def repeated_words(words: Column, width: int = 3) -> Column:
    """Number of words that stand in a window of ``width`` words found twice or more, first occurrences included."""
    def covered(w):
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) <= width, F.lit(0)).otherwise(let(hashes, marked))

    def marked(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, lambda s: let(places(s), total)))

    def places(s):
        twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def total(p):
        gains = F.transform(p, lambda x, i: F.when(i == 0, width).otherwise(F.least(F.lit(width), x - F.get(p, i - 1))))
        return F.aggregate(gains, F.lit(0), lambda a, x: a + x)

    return let(words, covered)


def ledger(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, the measurements, and failed: the bits of all rules that the document fails.

    whole: the document's own columns stay too, in the struct ``row``.
    """
    text = F.coalesce("text", F.lit(""))
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    words = let(split_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    rows = docs.select(
        *([packed(docs)] if whole else []), "doc_id", words.alias("w"),
        kept(r"[ \t-\r]+").alias("word_chars"),
        kept(r"[^#*$%&|<>]+").alias("n_symbols"),
        kept(r"[^A-Z]+").alias("n_capitals"),
        kept(r"[^A-Za-z]+").alias("n_ascii_letters"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    measured = rows.select(*(["row"] if whole else []), "doc_id", "w.*", "word_chars", "n_symbols", "n_capitals", "n_ascii_letters", "l.*")
    failed = sum((F.when(F.coalesce(rule(), F.lit(False)), BIT[name]).otherwise(0) for name, rule in RULES.items()), F.lit(0))
    return measured.withColumn("failed", failed.cast("int"))


def apply_policy(records: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with kept: whether the versioned policy keeps the document."""
    return records.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(records: DataFrame, policy: str = "v1") -> DataFrame:
    """rule, n_failed, n_kept, n_kept_without: what the policy keeps, and would keep without one of its rules.

    The ledger is first reduced to its distinct bitmasks, of which there are at most 2 ** rules.
    """
    masks = records.groupBy("failed").count()
    whole = POLICIES[policy]
    held = lambda bits: F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.lit(bits)) == 0, F.col("count"))), F.lit(0)).cast("long")
    rules = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.lit(b)) != 0, F.col("count"))), F.lit(0)).cast("long").alias("n_failed"), held(whole).alias("n_kept"), held(whole & ~b).alias("n_kept_without"))
        for n, b in BIT.items() if whole & b])
    return masks.agg(rules.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of the op8 query, and the failure bits."""
    return apply_policy(ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(POLICIES["base"])) != 0).alias("base_failed"), "kept", "failed")
