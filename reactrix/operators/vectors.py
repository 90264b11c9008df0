"""TF-IDF features of texts: n-grams of words or of characters inside words, a bounded vocabulary, sparse unit vectors.

Texts are cut by Spark's own functions. Inside tasks, batches of them become partial counts or vectors: no gram of a row is ever shuffled or joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import col
from .keyphrases import word_ngrams
from .matching import word_grams
from .ranges import stored

#: Grams that a task counts before it hands its sums over, and words whose grams it remembers.
TASK_GRAMS, TASK_WORDS = 1 << 18, 1 << 16
#: Rows that become vectors at once, and counts (rows x features) that are held for that.
SLICE_ROWS, SLICE_CELLS = 256, 1 << 21


def text_grams(c, analyzer: str = "word", ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """N-grams of a lower-cased text, repeats included; null is ''.

    word: n-grams of words of two characters or more. char_wb: character n-grams of each word with a blank at both ends; a word that is
    shorter than the least n is one gram.
    """
    text = F.coalesce(col(c), F.lit(""))
    if analyzer == "word":
        return word_ngrams(text, *ngram_range, [])
    if analyzer == "char_wb":
        words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
        return F.flatten(F.transform(words, lambda w: F.when(F.length(w) + 2 < ngram_range[0], F.array(F.concat(F.lit(" "), w, F.lit(" ")))).otherwise(word_grams(w, *ngram_range))))
    raise ValueError(f"unknown analyzer {analyzer}")


def kept(counts: DataFrame, n: int, min_df: float, max_df: float, max_features: int | None) -> DataFrame:
    """Rows (gram, df, total) within the bounds on n rows, or the max_features with the greatest totals, with their idf."""
    least, most = (x * n if isinstance(x, float) else x for x in (min_df, max_df))
    counts = counts.where((F.col("df") >= least) & (F.col("df") <= most))
    if max_features is not None:
        counts = counts.orderBy(F.col("total").desc(), "gram").limit(max_features)
    return counts.withColumn("idf", F.log((1.0 + F.lit(n)) / (1.0 + F.col("df"))) + 1)


def vocabulary(docs: DataFrame, id_col: str, grams: Column, min_df: float = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """gram, df, idf: grams in min_df rows or more and max_df or fewer (a share of all rows if a float, else a number), the
    max_features most frequent ones if that is given; ties go by gram."""
    per_row = docs.select(F.col(id_col), F.explode(grams).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias("tf"))
    counts = per_row.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return kept(counts, docs.count(), min_df, max_df, max_features).select("gram", "df", "idf")


def spaced(c, analyzer: str) -> Column:
    """The words of text_grams() in the lower-cased text, with one blank between them; words of one character are still there."""
    gaps = {"word": r"(?U)[^a-z0-9_\w]+", "char_wb": r"(?U)[ \t-\r\s]+"}  # what is ASCII needs no look at Unicode's tables
    if analyzer not in gaps:
        raise ValueError(f"unknown analyzer {analyzer}")
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), gaps[analyzer], " ")


def units(text: str, analyzer: str, low: int, high: int, of: set[str] | None = None) -> list[str]:
    """What a spaced() text is counted by: its n-grams of words, or for char_wb its words. of: words to which longer n-grams are limited."""
    if analyzer != "word":
        return [w for w in text.split(" ") if w]
    words = [w for w in text.split(" ") if len(w) > 1]
    out = list(words) if low == 1 else []
    for n in range(max(low, 2), high + 1):
        some = zip(*[words[k:] for k in range(n)], strict=False)
        out += map(" ".join, some if of is None else [g for g in some if of.issuperset(g)])
    return out


def inside(word: str, low: int, high: int) -> list[str]:
    """The character n-grams of a word."""
    p = f" {word} "
    return [p] if len(p) < low else [p[i : i + n] for n in range(low, high + 1) for i in range(len(p) - n + 1)]


def counting(analyzer: str, low: int, high: int, sent=None):
    """Batches of spaced() texts to sums (gram, df, total), handed over whenever a task has TASK_GRAMS of them. sent: a broadcast of the words to which longer n-grams are limited."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, sets = Counter(), Counter(), {}

        def told():
            total = seen
            if analyzer != "word":
                total = Counter()
                for word, n in seen.items():
                    for g in inside(word, low, high):
                        total[g] += n
            names = list(total)
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([df[g] for g in names], pa.int64()), pa.array([total[g] for g in names], pa.int64())], names=["gram", "df", "total"])
            df.clear(), seen.clear()
            return out

        for b in batches:
            for text in b.column(0):
                own = units(text.as_py(), analyzer, low, high, sent and sent.value)
                seen.update(own)
                if analyzer == "word":
                    df.update(set(own))
                else:
                    words = set(own)
                    for w in words:
                        if w not in sets:
                            sets[w] = frozenset(inside(w, low, high))
                    df.update(set().union(*[sets[w] for w in words]))
                    if len(sets) > TASK_WORDS:
                        sets.clear()
                if len(seen) > TASK_GRAMS or len(df) > TASK_GRAMS:
                    yield told()
        yield told()

    return run


def vectors_of(sent, analyzer: str, low: int, high: int, sublinear: bool):
    """Batches of spaced() texts to the fields of sparse unit vectors over the grams that were sent."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams, idf = sent.value
        at = {g: np.int32(k).tobytes() for k, g in enumerate(grams)}
        known = at if analyzer == "word" else {}

        def places(text):
            own = units(text, analyzer, low, high)
            if analyzer != "word":
                if len(known) > TASK_WORDS:
                    known.clear()
                for w in own:
                    if w not in known:
                        known[w] = b"".join([at[g] for g in inside(w, low, high) if g in at])
            return b"".join([known[u] for u in own if u in known])

        step = max(1, min(SLICE_ROWS, SLICE_CELLS // len(grams)))
        for texts in batches:
            sizes, indices, values = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
            for a in range(0, len(texts), step):
                found = [np.frombuffer(places(t.as_py()), np.int32) for t in texts[a : a + step]]
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                counts = np.bincount(row * len(grams) + np.concatenate(found), minlength=len(found) * len(grams))
                cell = np.flatnonzero(counts)
                row, place = np.divmod(cell, len(grams))
                weight = (1 + np.log(counts[cell]) if sublinear else counts[cell]) * idf[place]
                weight /= np.sqrt(np.bincount(row, weight * weight, len(found)))[row]
                sizes.append(np.bincount(row, minlength=len(found)))
                indices.append(place.astype(np.int32))
                values.append(weight)
            offsets = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (indices, values)]
            n = len(texts)
            yield pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(grams), np.int32)), *lists], names=["type", "size", "indices", "values"])

    return run


def totals(texts: DataFrame, text: str, analyzer: str, low: int, high: int, of: set[str] | None = None) -> DataFrame:
    """gram, df, total over all texts."""
    sent = None if of is None else texts.sparkSession.sparkContext.broadcast(of)
    sums = texts.select(spaced(text, analyzer).alias("t")).mapInArrow(counting(analyzer, low, high, sent), "gram string, df bigint, total bigint")
    return sums.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def frequent(words: DataFrame, n: int, min_df: float, max_df: float, max_features: int) -> set[str] | None:
    """The words (gram, df, total) of which a longer n-gram must consist to be among the max_features most frequent ones beside them; none if they aren't fewer than four times as many.

    A gram is no more frequent than each of its words, in texts and in all. If there are max_features words within the bounds, the last
    of them has a total that no n-gram with a rarer word reaches.
    """
    last = kept(words, n, min_df, max_df, max_features).agg(F.count("*").alias("n"), F.min("total").alias("total")).first()
    if last.n < max_features:
        return None
    found = words.where((F.col("total") >= last.total) & (F.col("df") >= (min_df * n if isinstance(min_df, float) else min_df))).limit(4 * max_features).collect()
    return {r.gram for r in found} if len(found) < 4 * max_features else None


class Vectorizer:
    """A fitted vocabulary of max_features grams at most, which is held by the driver."""

    def __init__(self, texts: DataFrame, text: str, analyzer: str = "word", ngram_range: tuple[int, int] = (1, 1), min_df: float = 2, max_df: float = 0.95, max_features: int = 30000, sublinear_tf: bool = True):
        self.text, self.analyzer, self.ngram_range, self.sublinear, self.most = text, analyzer, tuple(ngram_range), sublinear_tf, max_features
        (low, high), n, of = self.ngram_range, texts.count(), None
        if analyzer == "word" and low == 1 < high and max_features is not None:
            of = frequent(stored(totals(texts, text, analyzer, 1, 1), "words"), n, min_df, max_df, max_features)
        found = kept(totals(texts, text, analyzer, low, high, of), n, min_df, max_df, max_features).select("gram", "idf", "total").collect()
        #: The grams and their idf, the most frequent first.
        self.ranked = [(r.gram, r.idf) for r in sorted(found, key=lambda r: (-r.total, r.gram.encode()))]
        self._placed()

    def _placed(self):
        if not self.ranked:
            raise ValueError("no gram is left for the vocabulary")
        self.places = sorted(self.ranked)

    def narrowed(self, max_features: int, sublinear_tf: bool = True) -> Vectorizer:
        """The vectorizer that the same texts give with fewer features."""
        out = object.__new__(Vectorizer)
        out.text, out.analyzer, out.ngram_range, out.sublinear, out.most = self.text, self.analyzer, self.ngram_range, sublinear_tf, max_features
        out.ranked = self.ranked[:max_features]
        out._placed()
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with ``features``; a text without known grams has the zero vector."""
        sent = rows.sparkSession.sparkContext.broadcast(([g for g, _ in self.places], np.array([x for _, x in self.places])))
        run = vectors_of(sent, self.analyzer, *self.ngram_range, self.sublinear)

        @F.arrow_udf(returnType=VectorUDT())
        def vector(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return run(texts)

        return rows.withColumn("features", vector(spaced(self.text, self.analyzer)))
