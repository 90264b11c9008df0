"""Ranks, best rows and top-k with explicit tie keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import in_ranges, running


def rank_pct(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank over the count of known values, in percent; null stays null.

    Ranks are made over the distinct values, each with its count, in ranges of values, and joined back on the value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    order = [F.col("__v")]
    ranges = in_ranges(counts, *order)
    total = ranges.agg(F.sum("__n")).first()[0] or 1
    ranked = running(ranges, order, "__n", "__lower").select("__v", ((F.col("__lower") + (F.col("__n") + 1) / 2.0) / F.lit(total) * 100).alias(out))
    return df.join(ranked, F.col(value) == F.col("__v"), "left").drop("__v")


def best_in_group(df: DataFrame, groups: list[str], *order: Column, n: int = 1, rank: str = "__rank") -> DataFrame:
    """The first n rows of each group."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= n)
    return out.drop(rank) if rank == "__rank" else out


def top_k(df: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    """The k largest known values."""
    return df.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), *ties).limit(k)


def distinct_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the first by the given order."""
    return best_in_group(df, keys, *[F.col(c).asc_nulls_last() for c in order])


def band_best(df: DataFrame, groups: list[str], band: str, tolerance: float, *order: Column) -> DataFrame:
    """Of the rows within a tolerance of the group's largest value, the first by the given order."""
    most = F.max(band).over(Window.partitionBy(*groups))
    inside = df.withColumn("__most", most).where(F.col(band) >= F.col("__most") - tolerance).drop("__most")
    return best_in_group(inside, groups, *order)
