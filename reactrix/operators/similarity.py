"""Nearest vectors by cosine over an index of cells, exact by the triangle inequality.

Rows are reduced to distinct vectors, and these dealt to cells about centroids. For unit vectors the cosine falls as the distance grows, so a cell whose nearest possible
row, its centre's distance less its radius, is farther than what a query has found in its own cell can't hold a better one. Queries and rows meet in
blocks of bounded size, one matrix product each; the driver sees centroids and one row for each cell, never queries or rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import stored

#: Rows of a block.
BLOCK = 2048
#: Cells at most, rows of the sample that places their centres, and rounds of placing.
CELLS, SAMPLE, ROUNDS = 1024, 16_384, 8
#: Cosines are told apart to nine places; distances get so much slack.
SLACK = 1e-8


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def matrix(column) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(float)
    return unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def distances(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (m * m).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2.0 * m @ centres.T
    return np.sqrt(np.maximum(square, 0.0))


def centres(rows: DataFrame, n: int, cells: int | None, seed: int = 7) -> np.ndarray:
    """Centres of cells, placed by a bounded sample; where they are changes the work, never a result of the exact search."""
    share = min(1.0, 1.5 * SAMPLE / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(SAMPLE).toArrow()
    m = matrix(sample["v"])
    if not len(m):
        return np.zeros((1, 1))
    m = m[np.lexsort(m.T[::-1])]
    k = min(len(m), cells or int(np.clip(np.sqrt(n), 1, CELLS)))
    at = m[np.linspace(0, len(m) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        own = distances(m, at).argmin(axis=1)
        sums, counts = np.zeros_like(at), np.bincount(own, minlength=k)
        np.add.at(sums, own, m)
        at = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], at)
    return at


def with_cells(sent, name: str):
    """Rows with their cell and the distance to its centre."""
    def run(batches):
        for b in batches:
            if len(b):
                d = distances(matrix(b.column(name)), sent.value)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(d[np.arange(len(d)), own])], names=[*b.schema.names, "cell", "away"])

    return run


def visits(sent, parts: dict[int, int], radii: dict[int, float], own: bool, probes: int | None):
    """A row (cell, part, q, gid, v) for each block that a query has to meet: those of its own cell, or those of others that may hold a better row.

    Queries come with ``reach``, the distance of the best that they have found. probes: only so many cells, the nearest, which isn't exact.
    """
    def run(batches):
        cells = np.array(sorted(parts))
        radius = np.array([radii[c] for c in cells])
        for b in batches:
            if not len(b):
                continue
            m = matrix(b.column("v"))
            mine = b.column("cell").to_numpy()
            if own:
                meet = mine[:, None] == cells[None, :]
            else:
                d = distances(m, sent.value[cells])
                reach = np.where((m * m).sum(axis=1) > 0, b.column("reach").to_numpy(zero_copy_only=False), np.inf)  # a zero vector is alike far from all
                meet = (d - radius[None, :] <= np.sqrt(reach**2 + SLACK)[:, None]) & (mine[:, None] != cells[None, :])
                if probes is not None:
                    near = np.argsort(np.argsort(np.where(mine[:, None] == cells[None, :], -1.0, d), axis=1), axis=1)
                    meet &= near < probes
            row, cell = np.nonzero(meet)
            times = np.array([parts[c] for c in cells], int)[cell]
            for a in range(0, len(row), 4096):  # bounded batches
                r, t = row[a : a + 4096], times[a : a + 4096]
                take = pa.array(np.repeat(r, t))
                part = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cells[cell[a : a + 4096]], t), pa.int32()), pa.array(part, pa.int32()), *[b.column(c).take(take) for c in ("q", "gid", "v")]], names=["cell", "part", "q", "gid", "v"])

    return run


def best_of_blocks(batches):
    """q, id, cosine: the best row of a block for each query of a block, the query's own vector left out; ties, to nine places, go to the least id."""
    for b in batches:
        for k in range(len(b)):
            one = b.slice(k, 1)
            ids, qs, gids = (one.column(c).flatten() for c in ("ids", "qs", "gids"))
            if not len(ids) or not len(qs):
                continue
            rows, queries = (unit(one.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)) for c, n in (("rows", len(ids)), ("vs", len(qs))))
            order = np.array(sorted(range(len(ids)), key=ids.to_pylist().__getitem__))
            place = {x: n for n, x in enumerate(ids.take(pa.array(order)).to_pylist())}
            cosine = queries @ rows[order].T
            for n, g in enumerate(gids.to_pylist()):
                if g is not None and g in place:
                    cosine[n, place[g]] = -2.0
            at = np.round(cosine, 9).argmax(axis=1)  # the first of equal ones
            best = cosine[np.arange(len(at)), at]
            keep = np.flatnonzero(best > -2.0)
            yield pa.RecordBatch.from_arrays([qs.take(pa.array(keep)), ids.take(pa.array(order[at[keep]])), pa.array(best[keep])], names=["q", "id", "cosine"])


def least_two(rows: DataFrame) -> DataFrame:
    """v, a, b: the distinct vectors with the two least ids that have each. No buffer holds a vector's ids."""
    groups = stored(rows.groupBy("v").agg(F.min("id").alias("a"), F.count("*").alias("n")), "vectors")
    twice = groups.where("n > 1").select(F.col("v").alias("of_v"), "a")
    second = rows.join(twice, F.col("v") == F.col("of_v")).where("id > a").groupBy("v").agg(F.min("id").alias("b"))
    return groups.join(second.withColumnRenamed("v", "of_v"), F.col("v") == F.col("of_v"), "left").select("v", "a", "b")


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, block: int = BLOCK, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """query, vec, cosine: for each query the most similar other row; ties, to nine places, go to the least key.

    Exact; with ``probes`` only the rows of so many nearest cells (the own one included) are looked at, whose recall is for the caller to measure. Keys are unique; rows
    with a null key or vector are left out. Vectors have one length.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    fine = F.col(key).isNotNull() & F.col(vector).isNotNull()
    distinct = stored(least_two(rows.where(fine).select(F.col(key).alias("id"), F.col(vector).alias("v"))), "distinct")
    asked = queries.where(fine).select(F.col(key).alias("query"), F.col(vector).alias("v"))
    n = distinct.count()
    sent = spark.sparkContext.broadcast(centres(distinct, n, cells))
    vectors = rows.select(F.col(vector).alias("v")).schema["v"].dataType.simpleString()
    indexed = stored(distinct.mapInArrow(with_cells(sent, "v"), f"v {vectors}, a {kind}, b {kind}, cell int, away double"), "index")
    sizes = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # CELLS rows at most
    parts, radii = {r.cell: -(-r.n // block) for r in sizes}, {r.cell: r.radius for r in sizes}
    if not parts:
        return spark.createDataFrame([], f"query {kind}, vec {kind}, cosine double")
    number = F.lit(1)
    of = F.create_map(*[F.lit(x) for c in parts for x in (c, parts[c])])
    number = F.element_at(of, F.col("cell"))
    blocks = indexed.withColumn("part", F.pmod(F.xxhash64("a"), number).cast("int")).groupBy("cell", "part").agg(F.collect_list("a").alias("ids"), F.flatten(F.collect_list("v")).alias("rows"))
    blocks = stored(blocks, "blocks")

    own = asked.groupBy("v").agg(F.min("query").alias("q")).join(distinct.select(F.col("v").alias("of_v"), F.col("a").alias("gid")), F.col("v") == F.col("of_v"), "left").drop("of_v")
    own = stored(own.mapInArrow(with_cells(sent, "v"), f"v {vectors}, q {kind}, gid {kind}, cell int, away double"), "asked")
    groups = -(-own.count() // block) or 1

    def search(some: DataFrame, first: bool) -> DataFrame:
        pairs = some.mapInArrow(visits(sent, parts, radii, first, probes), f"cell int, part int, q {kind}, gid {kind}, v {vectors}")
        packed = pairs.groupBy("cell", "part", F.pmod(F.xxhash64("q"), F.lit(groups)).alias("of")).agg(F.collect_list("q").alias("qs"), F.collect_list(F.struct("gid")).alias("g"), F.flatten(F.collect_list("v")).alias("vs"))
        met = blocks.join(packed, ["cell", "part"]).select("ids", "rows", "qs", F.transform("g", lambda x: x["gid"]).alias("gids"), "vs")
        found = met.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("ids", "qs")).mapInArrow(best_of_blocks, f"q {kind}, id {kind}, cosine double")
        return found.groupBy("q").agg(F.max(F.struct(F.round("cosine", 9).alias("c"), (-F.col("id")).alias("least"), "cosine")).alias("m"))

    near = stored(search(own, True), "near")
    reach = F.when(F.col("m").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("m.cosine")))).otherwise(F.lit(float("inf")))
    # what a query's own copies have found bounds nothing else: they are compared at the end
    far = search(own.join(near, "q", "left").withColumn("reach", reach).drop("m"), False)
    other = near.unionByName(far).groupBy("q").agg(F.max("m").alias("m"))
    told = own.select(F.col("v").alias("of_v"), "q").join(other, "q", "left").join(distinct.select(F.col("v").alias("same_v"), "a", "b"), F.col("of_v") == F.col("same_v"), "left")
    all_ = asked.join(told, F.col("v") == F.col("of_v"))
    copy = F.when(F.col("query") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    alike = F.when(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)) > 0, 1.0).otherwise(0.0)  # zero vectors have no direction
    mine = F.when(copy.isNotNull(), F.struct(alike.alias("c"), (-copy).alias("least"), alike.alias("cosine")))
    best = all_.select("query", F.greatest(F.col("m"), mine).alias("m")).where("m is not null")
    return best.select("query", (-F.col("m.least")).cast(kind).alias("vec"), "m.cosine")
