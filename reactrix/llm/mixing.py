"""Mixing sources to target weights with a low-discrepancy schedule.

Slots 0, 1, 2, ... are mapped by golden-ratio points through the cumulative target shares to sources; the slots of a source
are ranked; slot k of a source takes the k-th block of ``block`` words from the source's shuffled word stream, which starts
anew when it ends. A document's taken words are the sum of its pieces in the blocks.

The schedule has as many slots as the mix has blocks, so it grows with the words and a block is always as long. A source's slots are within a few
of its share; its quota settles the rest: slots beyond it fall away, missing ones follow the last slot, and its last block is cut, so
that every source, however small, gives its target rounded to whole words.

Slots, documents and blocks meet by source and place in its stream, in parts of bounded length, and prefix sums are
two-level, so a source with a third of all rows is dealt over many tasks. Sources are numbered and added up in ranges, as
there may be many.

Defined results: null text has size 0; a null source is a source of its own, last in order; documents of size 0 take nothing;
very long documents span several blocks; rows alike (of equal doc_id and text) stand side by side in the stream in any order, so as a group they
take the same in each run; extra columns are left out (mix) or stay (attach); an empty table gives an empty mix. Only doc_id, text and source are read.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, clean_of, in_ranges, materialize, packed, running, split_words, text_key

#: Words of a block.
BLOCK = 1024
#: Golden ratio of 2 ** 62, odd: slot i is at the point (i * STEP mod 2 ** 62) / 2 ** 62, and no two slots are at one.
UNIT = 1 << 62
STEP = (isqrt(5 << 124) - UNIT) // 2 | 1
#: Coarse parts of the unit interval on which slots and sources meet by an equal key, at least; more for more sources.
PARTS = 4096
#: Slots of one chunk of the rank, and documents of one bucket of a stream as expected.
CHUNK, BUCKET_ROWS = 1 << 16, 100_000
#: Words of a part of a stream, on which documents and blocks meet.
GRAIN = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, h, size, place (in the source's shuffled order)."""
    rows = clean_of(docs, "doc_id", "text", "source").select("doc_id", "source", text_key(F.col("text")).alias("h"), word_total(F.col("text")).alias("size"))
    return rows.withColumn("place", shuffled_place("doc_id", "h"))


def word_total(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


def shuffled_place(doc_id: str, key: str) -> Column:
    """63 pseudo-random bits of a document; only rows alike share them."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, key), 1)


def by_name() -> Column:
    return F.col("source").asc_nulls_last()


def aimed_words() -> Column:
    return F.round("target").cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, weight, target: shares of the total by weight, none above ``most`` times the source's size.

    Sources filled in order of most * size / weight: those below the common level are full, the level of the others
    shares out what is left.
    """
    by_source = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    total = by_source.agg(F.sum("source_size")).first()[0] or 0
    numbered = running(in_ranges(by_source.withColumn("one", F.lit(1)), [by_name()], "named"), [by_name()], number="one")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = numbered.withColumn("weight", F.get(cycle, F.pmod(F.col("number"), F.lit(len(weights))).cast("int"))).withColumn("most", (most * F.col("source_size")).cast("double")).drop("__part", "number", "one")
    rows = materialize(rows, "weights")
    weight = rows.agg(F.sum("weight")).first()[0] or 1.0
    level = [F.col("most") / F.col("weight"), by_name()]
    shares = running(in_ranges(rows, level, "levels"), level, full="most", passed="weight").select(((F.lit(float(total)) - F.col("full")) / (F.lit(weight) - F.col("passed"))).alias("share"))
    # the share rises while it fills the sources before it and falls from there on: its maximum is the common level
    common = shares.agg(F.max("share")).first()[0] or 0.0
    return materialize(rows.select("source", "source_size", "weight", F.least(F.col("most"), common * F.col("weight")).alias("target")), "targets")


def prefix_sums(df: DataFrame, group: list[str], order: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """out: the sum of value over the earlier rows of the group. bucket must rise with the order."""
    low = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    low = low.select(*[F.col(c).alias(f"__{c}") for c in [*group, bucket]], F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    met = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*group, bucket]]
    joined = joined.join(low, met, "left")
    return joined.withColumn(out, F.col(out) + F.col("__before")).drop("__before", *[f"__{c}" for c in [*group, bucket]])


def golden_point(slot: Column) -> Column:
    """slot * STEP mod 2 ** 62 in halves of 31 bits: no product overflows, for any slot below 2 ** 62."""
    half, mask = 31, F.lit((1 << 31) - 1)
    high, low = F.shiftright(slot, half), slot.bitwiseAND(mask)
    upper = (high * F.lit(STEP & ((1 << 31) - 1)) + low * F.lit(STEP >> half)).bitwiseAND(mask)
    return (F.shiftleft(upper, half) + low * F.lit(STEP & ((1 << 31) - 1))).bitwiseAND(F.lit(UNIT - 1))


def schedule(aims: DataFrame, slots: int, first: int = 0) -> DataFrame:
    """slot, source, rank: each slot's source by its golden-ratio point, and its rank among the source's slots. aims: a table.

    first: the slot to begin with. Slots go up to 2 ** 62, so the words have no bound but that of a long.
    """
    spark = aims.sparkSession
    aimed = materialize(aims.select("source", aimed_words().alias("words")).where("words > 0"), "aimed")
    n, total = aimed.agg(F.count("*"), F.sum("words")).first()
    edges = running(in_ranges(aimed, [by_name()], "aims"), [by_name()], before="words")  # whole words, which add up alike in each run
    point = lambda x: F.round(x / F.lit(float(total or 1)) * UNIT).cast("long")
    edges = edges.select("source", point(F.col("before")).alias("lo"), point(F.col("before") + F.col("words")).alias("hi")).where("hi > lo")
    parts = max(PARTS, 1 << min(31, n.bit_length()))
    wide = UNIT // parts
    edges = materialize(edges.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))).alias("part")), "edges")
    points = spark.range(first, first + slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point")).withColumn("part", F.floor(F.col("point") / wide))
    placed = points.join(bounded(edges, edges.count()), "part").where("point >= lo and point < hi").select("slot", "source", F.floor(F.col("slot") / CHUNK).alias("chunk"), F.lit(1).cast("long").alias("one"))
    return prefix_sums(placed, ["source"], ["slot"], "chunk", "one", "rank").select("slot", "source", "rank")


def quotas(timetable: DataFrame, aims: DataFrame, block: int, slots: int) -> DataFrame:
    """slot, source, source_size, rank, at, until: the blocks of the mix, words [at, until) of the source's endless stream.

    Slots whose rank is beyond the source's target fall away; those that a source lacks follow the schedule, and the last block ends at the target.
    """
    ends = aims.select(F.col("source").alias("of_source"), "source_size", aimed_words().alias("words")).where("words > 0")
    ends = ends.withColumn("quota", F.ceil(F.col("words") / block))
    n = ends.count()
    same = F.col("source").eqNullSafe(F.col("of_source"))
    given = timetable.groupBy("source").agg(F.count("*").alias("n_slots"))
    more = ends.join(bounded(given, n), same, "left").withColumn("n_slots", F.coalesce("n_slots", F.lit(0))).where("n_slots < quota")
    # closing slots: by rank, so that sources take turns
    more = more.select(F.col("of_source").alias("source"), F.explode(F.sequence(F.col("n_slots"), F.col("quota") - 1)).alias("rank")).select((F.lit(slots) + F.col("rank")).cast("long").alias("slot"), "source", F.col("rank").cast("long").alias("rank"))
    cut = timetable.unionByName(more).join(bounded(ends, n), same).where("rank < quota")
    at = F.col("rank") * block
    return cut.select("slot", "source", "source_size", "rank", at.alias("at"), F.least(at + block, F.col("words")).alias("until"))


def plan(docs: DataFrame, block: int, weights: tuple[int, ...], most: int):
    """(stream: the documents with first_word, their place in their source's stream; aims; cut: the mix's blocks)."""
    sized = materialize(sizes(docs), "sizes")
    aims = targets(sized, weights, most)
    n_rows = sized.count()
    bits = max(6, (n_rows // BUCKET_ROWS).bit_length())
    stream = prefix_sums(sized.where("size > 0").withColumn("bucket", F.shiftrightunsigned("place", 63 - bits)), ["source"], ["place", "doc_id", "h"], "bucket", "size", "first_word").drop("bucket")
    stream = materialize(stream.unionByName(sized.where("size = 0").withColumn("first_word", F.lit(0).cast("long"))), "stream")
    slots = -(-(aims.agg(F.sum(aimed_words())).first()[0] or 0) // block)
    timetable = materialize(schedule(aims, slots), "schedule")
    return stream, aims, materialize(quotas(timetable, aims, block, slots), "blocks")


def pieces(stream: DataFrame, cut: DataFrame) -> DataFrame:
    """slot, rank, source, doc_id, h, first_word, lap, from_word, to_word: each block as pieces of documents.

    Blocks and documents meet on equal parts of the source's stream; what spans several parts is listed in each, and a piece is told by the part in which it begins.
    """
    laps = F.sequence(F.floor(F.col("at") / F.col("source_size")), F.floor((F.col("until") - 1) / F.col("source_size")))
    # a block that passes the end of the stream goes on at the start
    cut = cut.withColumn("lap", F.explode(laps)).select("slot", "rank", "source", "lap", F.greatest(F.lit(0), F.col("at") - F.col("lap") * F.col("source_size")).alias("lo"), F.least(F.col("source_size"), F.col("until") - F.col("lap") * F.col("source_size")).alias("hi"))
    cut = cut.withColumn("part", F.explode(F.sequence(F.floor(F.col("lo") / GRAIN), F.floor((F.col("hi") - 1) / GRAIN))))
    rows = stream.where("size > 0").select(F.col("source").alias("of_source"), "doc_id", "h", "size", "first_word")
    rows = rows.withColumn("of_part", F.explode(F.sequence(F.floor(F.col("first_word") / GRAIN), F.floor((F.col("first_word") + F.col("size") - 1) / GRAIN))))
    met = rows.join(cut, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("part") == F.col("of_part")))
    low, high = F.greatest("lo", "first_word"), F.least(F.col("hi"), F.col("first_word") + F.col("size"))
    met = met.where((low < high) & (F.floor(low / GRAIN) == F.col("part")))
    return met.select("slot", "rank", "source", "doc_id", "h", "first_word", "lap", (low - F.col("first_word")).alias("from_word"), (high - F.col("first_word")).alias("to_word"))


def blocks(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself, in order of slot, source, lap, first_word: each slot's block as pieces of documents."""
    stream, _, cut = plan(docs, block, weights, most)
    return pieces(stream, cut)


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, h, source, size, place, source_size, target, taken: one row for each input row."""
    stream, aims, cut = plan(docs, block, weights, most)
    taken = pieces(stream, cut).select("source", "first_word", (F.col("to_word") - F.col("from_word")).alias("taken")).groupBy(F.col("source").alias("in_source"), F.col("first_word").alias("at_word")).agg(F.sum("taken").alias("taken"))
    aims = aims.select(F.col("source").alias("of_source"), "source_size", "target")
    # a source and first word are of one document that has words; documents without words have none
    rows = stream.join(taken, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("first_word") == F.col("at_word")) & (F.col("size") > 0), "left")
    rows = rows.join(bounded(aims, aims.count()), F.col("source").eqNullSafe(F.col("of_source")), "left")
    return rows.select("doc_id", "h", "source", "size", "place", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def attach(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs that the mix takes words of, with size, source_size, target and taken; its own columns of such names are called own_size and so on.

    The mix's rows are reduced to what distinguishes the documents of a source: those before one place of the shuffled order have given a lap
    more than those behind it, and what is at it a part. The texts are read once more by that and go nowhere. Rows alike at that place share its part.
    """
    mixed = materialize(mix(docs, block, weights, most).where("size > 0"), "mix")
    laps = mixed.groupBy(F.col("source").alias("of_source")).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.min(F.floor(F.col("taken") / F.col("size"))).alias("laps"))
    laps = materialize(laps, "laps")
    n = laps.count()
    same = F.col("source").eqNullSafe(F.col("of_source"))
    # the last place that has given more than the laps of its source
    over = mixed.join(bounded(laps.select("of_source", "laps"), n), same).withColumn("more", F.col("taken") - F.col("laps") * F.col("size")).where("more > 0")
    edge = over.groupBy("source").agg(F.max("place").alias("edge"))
    edge = edge.select(F.col("source").alias("at_source"), "edge")
    at = mixed.join(bounded(edge, n), F.col("source").eqNullSafe(F.col("at_source")) & (F.col("place") == F.col("edge"))).groupBy("at_source", "edge").agg(F.sum("taken").alias("given"), F.sum("size").alias("tied"))
    ends = materialize(laps.join(at, F.col("of_source").eqNullSafe(F.col("at_source")), "left").drop("at_source"), "ends")
    added = ["size", "source_size", "target", "taken"]
    docs = docs.withColumnsRenamed({c: f"own_{c}" for c in added})
    rows = docs.select(packed(docs), "source", "doc_id", text_key(F.col("text")).alias("h"), word_total(F.col("text")).alias("size"))
    rows = rows.withColumn("place", shuffled_place("doc_id", "h")).join(bounded(ends, ends.count()), same, "left")
    part = F.when(F.col("place") < F.col("edge"), (F.col("laps") + 1) * F.col("size")).when(F.col("place") == F.col("edge"), F.floor(F.col("size") * F.col("given") / F.col("tied"))).otherwise(F.col("laps") * F.col("size"))
    return rows.withColumn("taken", F.coalesce(part, F.lit(0)).cast("long")).where("taken > 0").select("row.*", *added)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of the op10 query."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
