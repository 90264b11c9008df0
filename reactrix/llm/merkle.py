"""Merkle manifest of a data set, with one proof for each document.

Leaves of a source are numbered in order and gathered in blocks of BLOCK = 3 ^ LEVELS, arrays of a fixed size. Native higher-order
functions collapse a block: sequence() makes a level's runs, transform() over slices hashes them, aggregate() goes up the levels. Block roots are the
leaves of the next round, until a source has one root; the sources' roots make one more tree. Proofs come from the top down: a block gets the
siblings above its root, and adds those inside.

A source of any size is spread over blocks: no task holds more than a range of rows in order, no array more than BLOCK nodes. Rounds are logarithmic (eight are beyond 10^22 rows).

Defined results: a null doc_id stands before all others, and a null source before all others and the empty one; null fields are ``-``; rows that share a doc_id are ordered by their leaf,
repeated rows have places of their own and equal leaves; very long texts are hashed whole; an empty table has no rows and no root; extra columns don't count. Nulls have no crc32 and are never tampered with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, clean_of, let, materialize

WIDTH, LEVELS = 3, 6
BLOCK = WIDTH**LEVELS
#: Rows of a range, where leaves are numbered, and the number of ranges at most.
RANGE_ROWS, RANGES = 20_000, 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def tampered_text() -> Column:
    """The text as a tamperer leaves it: without line ends where the crc32 of doc_id is even."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def leaves(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """key (the source, so marked that null comes first), doc_id, leaf, and ``now``, the leaf over the text found at a check (the same by default)."""
    rows = clean_of(docs, *FIELDS).withColumn("leaf", leaf_hash(F.col("text")))
    found = F.col("leaf") if now is None else F.when(now.eqNullSafe(F.col("text")), F.col("leaf")).otherwise(leaf_hash(now))
    return rows.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key"), "doc_id", "leaf", found.alias("now"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``idx``, their place (from 0) in the order inside their key, and ``total``, the key's rows.

    Rows are dealt by ranges of the order, which split a large key; places inside a range are a window's, what is before it is added from the counts of ranges.
    """
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "leaves")
    n = rows.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    dealt = materialize(rows.repartitionByRange(ranges, "key", *order, "at").withColumn("part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(F.col("part").alias("of_part"), F.col("key").alias("of_key")).agg(F.count("*").alias("n"))
    in_key = Window.partitionBy("of_key")  # a row for each range of a key
    counts = materialize(counts.select("of_part", "of_key", F.coalesce(F.sum("n").over(in_key.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(in_key).alias("total")), "counts")
    inside = Window.partitionBy("part", "key").orderBy(*order, "at")
    met = dealt.withColumn("inside", F.row_number().over(inside)).join(bounded(counts, counts.count()), (F.col("part") == F.col("of_part")) & (F.col("key") == F.col("of_key")))
    return met.withColumn("idx", F.col("before") + F.col("inside") - 1).drop("at", "part", "of_part", "of_key", "before", "inside")


def blocks_of(rows: DataFrame, *carried: str) -> DataFrame:
    """key, block, total, members: rows (key, idx, total, node, carried) in arrays of BLOCK, in order."""
    member = F.struct("idx", "node", *carried)
    return rows.groupBy("key", F.floor(F.col("idx") / BLOCK).cast("bigint").alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members"))


def depth() -> Column:
    """Levels inside a block: all of them in a key of many blocks, else as many as lead to one node."""
    powers = F.array(*[F.lit(WIDTH**k) for k in range(LEVELS)])
    return F.when(F.col("total") > BLOCK, LEVELS).otherwise(F.size(F.filter(powers, lambda p: p < F.size("members"))))


def parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / WIDTH).cast("int"))
    return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(nodes, k * WIDTH + 1, F.lit(WIDTH)), ""), 256))


def steps() -> Column:
    return F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.lit(1), depth())


def levels() -> Column:
    """All levels of a block, from its nodes to its root."""
    nodes = F.transform("members", lambda m: m["node"])
    return F.aggregate(steps(), F.array(nodes), lambda got, _: F.concat(got, F.array(parents(F.element_at(got, -1)))))


def siblings(level: Column, place: Column) -> Column:
    """Nodes to the left and right in the run of the node at a place (from 0), each side as one text."""
    own = (place % WIDTH).cast("int")
    return let(F.slice(level, place - own + 1, F.lit(WIDTH)), lambda run: F.struct(F.array_join(F.slice(run, F.lit(1), own), "").alias("left"), F.array_join(F.slice(run, own + 2, F.lit(WIDTH)), "").alias("right")))


def path(tree: Column, place: Column) -> Column:
    """The siblings of the member at a place, level by level up to the block's root."""
    powers = F.array(*[F.lit(WIDTH**k) for k in range(LEVELS)])
    return F.transform(steps(), lambda j: siblings(F.get(tree, j), F.floor(place / F.get(powers, j)).cast("int")))


@dataclass
class Manifest:
    """Blocks of each round from the leaves up (key, block, total, members), those of the tree over sources, the sources' roots (key, node, round) and the root."""

    rounds: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None


def tower(nodes: DataFrame, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of each round, roots): collapses until each key has one node."""
    rounds, ended = [], []
    while True:
        blocks = materialize(blocks_of(nodes, *carried), "blocks")
        rounds.append(blocks)
        root = F.element_at(F.element_at(levels(), -1), 1)
        up = materialize(blocks.select("key", F.col("block").alias("idx"), F.ceil(F.col("total") / BLOCK).cast("bigint").alias("total"), root.alias("node")), "roots")
        ended.append(up.where("total <= 1").select("key", "node", F.lit(len(rounds) - 1).alias("round")))
        nodes, carried = up.where("total > 1"), ()
        if nodes.isEmpty():
            break
    roots = ended[0]
    for more in ended[1:]:
        roots = roots.unionByName(more)
    return rounds, roots


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of leaves()."""
    rounds, subroots = tower(placed(rows, "doc_id", "leaf").withColumnRenamed("leaf", "node"), "doc_id", "now")
    top, root = tower(placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("of"), "node"), "of"), "of")
    first = root.first()
    return Manifest(rounds, top, subroots, first.node if first else None)


def down(blocks: DataFrame, above: DataFrame, make) -> DataFrame:
    """key, and make(member, path, the row above) of each member. above: key, block, ``up`` (siblings above the block's root) and columns to carry."""
    met = blocks.join(above, ["key", "block"])
    carried = [c for c in above.columns if c not in ("key", "block", "up")]
    made = let(levels(), lambda tree: F.transform("members", lambda m, i: make(m, F.concat(path(tree, i), F.col("up")))))
    return met.select("key", *carried, F.inline(made))


def proofs(m: Manifest, spark) -> DataFrame:
    """doc_id, leaf, now, subroot, root, proof (an array of siblings to the left and right, level by level up to the root) of every leaf."""
    nothing = F.expr("cast(array() as array<struct<left:string,right:string>>)")
    step = lambda x, p: F.struct(x["idx"].alias("block"), p.alias("up"))
    above = spark.range(1).select(F.lit("").alias("key"), F.lit(0).cast("bigint").alias("block"), nothing.alias("up"), F.lit(m.root).alias("root"))
    for blocks in m.top[:0:-1]:
        above = down(blocks, above, step)
    tops = down(m.top[0], above, lambda x, p: F.struct(x["of"].alias("of"), x["node"].alias("subroot"), p.alias("up"))).drop("key").withColumnRenamed("of", "key")
    tops = materialize(tops.join(m.subroots.select("key", "round"), "key"), "tops")
    above = None
    for k in reversed(range(len(m.rounds))):
        own = tops.where(F.col("round") == k).select("key", F.lit(0).cast("bigint").alias("block"), "up", "root", "subroot")
        above = own if above is None else own.unionByName(above)
        if k:
            above = materialize(down(m.rounds[k], above, step), "above")
    return down(m.rounds[0], above, lambda x, p: F.struct(x["doc_id"].alias("doc_id"), x["node"].alias("leaf"), x["now"].alias("now"), p.alias("proof"))).drop("key")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document, half of which are tampered with before the check."""
    m = manifest(leaves(docs, tampered_text()))
    rows = proofs(m, docs.sparkSession)
    flat = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    rows = rows.withColumns({"proof_sha256": F.sha2(flat, 256), "folded_root": folded(F.col("now"), F.col("proof"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
