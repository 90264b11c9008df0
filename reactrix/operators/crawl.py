"""Rules for crawled posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import REACTIONS
from ..functions.text import parsed_count

# Names of a reaction, in the order they are tried; 'thích' comes before 'yêu thích' and wins over it.
SYNONYMS = {
    "thích": "like", "like": "like",
    "yêu thích": "love", "love": "love",
    "haha": "haha", "wow": "wow",
    "buồn": "sad", "sad": "sad",
    "phẫn nộ": "angry", "angry": "angry",
    "thương thương": "care", "care": "care",
}


def canonical_reaction(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for text, key in reversed(SYNONYMS.items()):
        out = F.when(F.contains(low, F.lit(text)), key).otherwise(out)
    return out


# A label tells of people if it has one of these words; its first number, which may be rounded to a unit.
PEOPLE, COUNT = "(?iu)người|people|times", r"([\d.,]+\s*[KkMmBb]?)"


def labelled_reactions(labels: Column) -> Column:
    """(counts, rounded) of a post's labels: the largest count that a label tells of each known reaction, as a map.

    Labels without a word for people, or without a number, are left out. A rounded number ("1,2K", but "3 more" as well) ends the reading, as exact counts must
    be looked up then; what was read before it stays. Names of no known reaction and unreadable numbers count nothing. A null array has no counts.
    """
    told = F.filter(F.coalesce(labels, F.expr("cast(array() as array<string>)")), lambda x: x.rlike(PEOPLE) & x.rlike(COUNT))
    read = F.transform(told, lambda x: F.struct(canonical_reaction(x).alias("key"), F.upper(F.regexp_extract(x, COUNT, 1)).alias("number")))

    def counted(r):
        end = F.array_position(F.transform(r, lambda x: x["number"].rlike("[KMB]")), F.lit(True))
        exact = F.slice(r, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(r)).cast("int"))
        most = lambda key: F.array_max(F.transform(F.filter(exact, lambda x: x["key"] == key), lambda x: parsed_count(x["number"])))
        counts = F.create_map(*[x for key in REACTIONS for x in (F.lit(key), F.coalesce(most(key), F.lit(0)).cast("bigint"))])
        return F.struct(counts.alias("counts"), (end > 0).alias("rounded"))

    return F.element_at(F.transform(F.array(read), counted), 1)


def reaction_columns(counts: Column) -> list[Column]:
    """The seven known reactions of a map; missing ones, and those of a null map, are 0."""
    return [F.coalesce(F.try_element_at(counts, F.lit(r)), F.lit(0)).cast("bigint").alias(r) for r in REACTIONS]


def total_reactions(counts: Column, displayed: Column) -> Column:
    """The sum of the map if it is positive, else the displayed total."""
    total = F.aggregate(F.coalesce(F.map_values(counts), F.expr("cast(array() as array<bigint>)")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(total > 0, total).otherwise(displayed).cast("bigint")


def accepted(df: DataFrame, group: str, order: list[str], old: str, most: int) -> DataFrame:
    """Rows of a group that aren't old and come before the end of the first run of ``most`` old rows."""
    w = Window.partitionBy(group).orderBy(*order)
    streak = F.lit(True)
    for k in range(most):
        streak = streak & F.coalesce(F.lag(old, k).over(w), F.lit(False))
    ended = F.max(F.col("__end").cast("int")).over(w)
    return df.withColumn("__end", streak).withColumn("__ended", ended).where((F.col("__ended") == 0) & ~F.col(old)).drop("__end", "__ended")
