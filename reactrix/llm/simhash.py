"""SimHash near-duplicates with a Gray-order hierarchical Hamming index.

Fingerprints are computed in Arrow batches and reduced to the distinct ones, so exact copies cost one row. Links of up
to ``radius`` differing bits come from the index: the bits are cut into m segments, and two linked fingerprints
agree on at least m - radius of them. Each way to keep m - radius segments is an upper node pattern of the index
(a masked bit pattern that all fingerprints below share); fingerprints are dealt by pattern, sorted by Gray rank in it,
and each block is searched by ``hamming.classes``, which factors shared patterns and prunes whole groups. A block
gives a spanning forest of its links, never all pairs.

A crowded pattern goes down the hierarchy: the bits that it leaves open are cut into segments once more, and its fingerprints are dealt by
the longer patterns, which lose no link for the same reason. Bits run out after four levels at most, so blocks end at a bounded size. Patterns of up to
SPLIT tiles are cut into tiles that meet pairwise instead. No level makes more than SPLIT rows of one.

m grows with the number of fingerprints so that random blocks stay small; every m finds exactly the same links.

Defined results: null and blank texts have fingerprint zero and are linked like others; null doc_ids keep their row
and count as no smallest id; repeated rows keep their rows; very long texts are hashed in pieces, whole; a fingerprint bit set in exactly half the shingles is 0;
empty tables give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hamming
from .common import bounded, clean_of, drop_table, materialize, spread_join
from .components import components

cloudpickle.register_pickle_by_value(hamming)

#: Fingerprints that meet in a block before it is cut into tiles.
TILE = 1024
#: Tiles of a pattern above which it is split by longer patterns; also the most rows that a level makes of one.
SPLIT = 16
#: Expected fingerprints in a block of random ones, above which one more segment is used.
CROWD = 1024


def gray_rank(fp):
    """Place of fp in the Gray code order, as a signed number that sorts in that order."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def kept_segments(bits: list[int], m: int, radius: int) -> list[int]:
    """Masks of all ways to keep m - radius of the m segments into which the bits are cut."""
    edges = [len(bits) * k // m for k in range(m + 1)]
    parts = [sum(1 << b for b in bits[edges[k] : edges[k + 1]]) for k in range(m)]
    return [sum(kept) for kept in combinations(parts, m - radius)]


def patterns(count: int, radius: int) -> list[int]:
    """Masks (signed) of the upper nodes for so many distinct fingerprints."""
    m = radius + 1
    while m < 16 and count / 2 ** (64 * (m - radius) / m) > CROWD:
        m += 1
    return [signed(x) for x in kept_segments(list(range(64)), m, radius)]


def longer(mask: int, radius: int) -> list[int]:
    """Masks (signed) of the nodes below a mask: 15 ways, for a radius of 4, to keep two of the segments of its open bits."""
    own = mask & (1 << 64) - 1
    return sorted({signed(own | x) for x in kept_segments([b for b in range(64) if not own >> b & 1], radius + 2, radius)})


def fingerprint_table(docs: DataFrame, width: int = 4, order: str = "doc_id") -> DataFrame:
    """The order column and fp: one row for each input row."""
    docs = clean_of(docs, order, "text")
    schema = f"`{order}` {docs.schema[order].dataType.simpleString()}, fp bigint"
    return docs.mapInArrow(hamming.fingerprints(width, order), schema)


def dealt(distinct: DataFrame, radius: int, tile: int, split: int = SPLIT) -> DataFrame:
    """fp, mask, pattern, a, b: every fingerprint in the blocks (mask, pattern, a, b) in which it meets others."""
    spark, done = distinct.sparkSession, []
    open_, masks = distinct.select("fp"), patterns(distinct.count(), radius)
    routed = open_.select("fp", F.explode(F.array(*[F.lit(x) for x in masks])).alias("mask"))
    while True:
        routed = routed.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        crowds = materialize(routed.groupBy("mask", "pattern").count().where(F.col("count") > tile), "crowds")
        n = crowds.count()
        if not n:
            done.append(routed.select("fp", "mask", "pattern", F.lit(0).alias("a"), F.lit(0).alias("b")))
            break
        sized = routed.join(bounded(crowds, n), ["mask", "pattern"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / tile), F.lit(1)).cast("int"))
        low = sized.where(F.col("blocks") <= split).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        done.append(low.select("fp", "mask", "pattern", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")))
        high = [r.mask for r in crowds.where(F.col("count") > split * tile).select("mask").distinct().collect()]  # masks are told by the level, not by the data
        if not high:
            break
        below = spark.createDataFrame([(x, y) for x in high for y in longer(x, radius)], "mask bigint, next bigint")
        routed = materialize(sized.where(F.col("blocks") > split).select("fp", "mask").join(F.broadcast(below), "mask").select("fp", F.col("next").alias("mask")).distinct(), "routed")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def links(distinct: DataFrame, radius: int = 4, tile: int = TILE, split: int = SPLIT) -> DataFrame:
    """(u, v) links that join exactly the fingerprints which chains of up to ``radius`` differing bits join."""
    keys = ["mask", "pattern", "a", "b"]
    blocks = dealt(distinct, radius, tile, split)
    return blocks.repartition(*keys).sortWithinPartitions(*keys, gray_rank(F.col("fp"))).select("fp", *keys).mapInArrow(hamming.block_links(radius, keys), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, order: str = "doc_id") -> DataFrame:
    """The order column, fingerprint (16 hex digits) and component_id (its least value in the class), one row for each input row.

    Neither a class nor a fingerprint that many rows share is dealt to one task: least values are combined before the
    shuffle and go back by spread_join().
    """
    prints = materialize(fingerprint_table(docs, width, order), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(order).alias("least"), F.count("*").alias("n_rows")), "distinct")
    n = distinct.count()
    roots = components(links(distinct.select("fp"), radius))
    members = materialize(distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "members")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    classes = materialize(spread_join(members.select("fp", "n_rows", "root"), least, "root", "n", n).select("fp", "n_rows", "component_id"), "classes")
    for used in (distinct, members):
        drop_table(used)
    return spread_join(prints, classes, "fp", "n_rows", prints.count()).select(order, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
