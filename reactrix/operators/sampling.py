"""Stratified sampling in a hash order, which is the same in every run and engine.

No sampler ranks a whole group in one task and none deals rows on the driver. Quotas find each group's edge in the hash order from counts; deals without
reuse (round robin, label by label) are claim rounds over the heads of the pools.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import in_ranges, row_numbers, running, stored

#: Rows about a group's edge that are ranked in one task; with more, the edge is looked for with more digits of the hash.
EDGE_ROWS = 1_000_000
#: Hexadecimal digits that each look adds.
DIGITS = 3
#: Groups whose edges are broadcast.
BROADCAST_GROUPS = 100_000
#: Rows that the pools of a round robin offer to one round.
DEAL_ROWS = 200_000


def shuffle_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))


def _same(names: list[str]) -> Column:
    same = F.lit(True)
    for g in names:
        same &= F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return same


def take_per_group(df: DataFrame, groups: list[str], quota: Column, id_col: str, seed: int) -> DataFrame:
    """Up to quota rows of each group, the first in hash order. quota is the same for all rows of a group; of a null one nothing is taken.

    Rows are counted by group and the first digits of their hash. What is before the digits at which the quota is reached is taken whole, and only rows
    with those digits are ranked; if they are many, more digits are looked at. df is stored first: it should have no wide columns.
    """
    kept = stored(df.withColumns({"__quota": quota.cast("bigint"), "__hash": shuffle_key(id_col, seed)}).where("__quota > 0"), "pool")
    digits, rest, taken = 0, kept.withColumn("__need", F.col("__quota")), []
    own = Window.partitionBy(*groups).orderBy("__digits").rowsBetween(Window.unboundedPreceding, -1)  # 16 ^ DIGITS rows of a group
    while True:
        digits += DIGITS
        rest = rest.withColumn("__digits", F.substring("__hash", 1, digits))
        counts = rest.groupBy(*groups, "__digits").agg(F.count("*").alias("__n"), F.max("__need").alias("__need"))
        counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(own), F.lit(0)))
        edge = counts.where("__before < __need and __before + __n >= __need")
        edge = stored(edge.select(*[F.col(g).alias(f"__of_{g}") for g in groups], F.col("__digits").alias("__edge"), (F.col("__need") - F.col("__before")).alias("__left"), "__n"), "edges")
        n, most = edge.agg(F.count("*"), F.max("__n")).first()
        sent = edge.drop("__n")
        met = rest.join(F.broadcast(sent) if n <= BROADCAST_GROUPS else sent, _same(groups), "left").drop(*[f"__of_{g}" for g in groups])
        taken.append(met.where("__edge is null or __digits < __edge").drop("__edge", "__left"))  # groups without an edge are within their quota
        rest = met.where("__digits = __edge").withColumn("__need", F.col("__left")).drop("__edge", "__left")
        if not n:
            break
        if most <= EDGE_ROWS or digits >= 30:
            w = Window.partitionBy(*groups).orderBy("__hash", id_col)
            taken.append(rest.withColumn("__rank", F.row_number().over(w)).where("__rank <= __need").drop("__rank"))
            break
        rest = stored(rest, "edge_rows")
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.select(*df.columns)


def quota_grid(df: DataFrame, quotas: DataFrame, keys: list[str], id_col: str, seed: int) -> DataFrame:
    """Rows of each cell of the quota table (keys, quota), as many as its quota."""
    n = quotas.count()
    return take_per_group(df.join(F.broadcast(quotas) if n <= BROADCAST_GROUPS else quotas, keys), keys, F.col("quota"), id_col, seed).drop("quota")


def claims(pools: DataFrame, id_col: str, quota: int) -> DataFrame:
    """pool, id: up to ``quota`` rows of each pool, the first in its order that no earlier pool took. pools: (pool, id, rank), a row for each row of a pool.

    Rounds: every pool claims the first of its free rows, a row goes to the earliest pool that claims it, and isn't free for the others in the next round. The first
    pool's claims hold at once, those of the k-th after k rounds at the latest, so there are no more rounds than pools and one. Places in a pool are
    counted over ranges: a pool of any size is spread.
    """
    order = [F.col("pool"), F.col("rank")]
    now = in_ranges(pools.select("pool", F.col(id_col).alias("id"), "rank").withColumn("free", F.lit(1)), *order)
    while True:
        placed = running(now, order, "free", "before", ["pool"])
        claim = F.struct("pool", "rank", "free", (F.col("before") < quota).alias("within"), F.col("__range_no").alias("at"))
        # a row has as many claims as there are pools at most
        rows = placed.groupBy("id").agg(F.min(F.when(F.col("before") < quota, F.col("pool"))).alias("holder"), F.collect_list(claim).alias("all")).select("id", "holder", F.explode("all").alias("c"))
        free = (F.col("holder").isNull() | (F.col("c.pool") <= F.col("holder"))).cast("int")
        step = stored(rows.select("id", "c.pool", "c.rank", free.alias("free"), F.col("c.free").alias("was"), (F.col("c.within") & (F.col("c.pool") == F.col("holder"))).alias("taken"), F.col("c.at").alias("__range_no")), "claims")
        if step.where("free <> was").isEmpty():
            return step.where("taken").select("pool", F.col("id").alias(id_col))
        now = step.drop("was", "taken")


def heads(df: DataFrame, pools: list[tuple[str, Column]], most: int, id_col: str, *order: Column, seed: int = 0) -> DataFrame:
    """pool (its number), id, rank: the first ``most`` rows of each pool, in the given order, else in hash order."""
    member = F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, (_, cond) in enumerate(pools)]))
    if not order:
        rows = take_per_group(df.select(id_col, F.explode(member).alias("pool")), ["pool"], F.lit(most), id_col, seed)
        return rows.withColumn("rank", F.struct(shuffle_key(id_col, seed).alias("h"), F.col(id_col).alias("id")))
    rows = stored(df.select(id_col, F.explode(member).alias("pool"), F.struct(*order, F.col(id_col).alias("id")).alias("rank")), "pools")
    placed = running(in_ranges(rows.withColumn("one", F.lit(1)), F.col("pool"), F.col("rank")), [F.col("pool"), F.col("rank")], "one", "before", ["pool"])
    return placed.where(F.col("before") < most).select("pool", id_col, "rank")


def laps(window: int, starts: list[int], sizes: list[int], first: int, most: int):
    """Deals whole laps over the pools' windows, until one ends before its pool does. Gives pool, id, lap, at of what is dealt, and without an id where each pool is continued."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("pool", "ascending"), ("at", "ascending")])
        pool, at = rows["pool"].to_numpy(), rows["at"].to_numpy()
        ids = rows["id"].to_pylist()
        edges = np.searchsorted(pool, np.arange(len(sizes) + 1))
        ends = [min(s + window, n) for s, n in zip(starts, sizes, strict=True)]
        now, used, out, lap = list(edges[:-1]), set(), [], first
        going = True
        while going and len(out) < most:
            spots, got, going = list(now), [], False
            for p, n in enumerate(sizes):
                k = spots[p]
                while k < edges[p + 1] and ids[k] in used:
                    k += 1
                if k < edges[p + 1]:
                    got.append(k)
                    used.add(ids[k])
                    k += 1
                elif ends[p] < n:  # the window ends inside the lap, which waits for the next round
                    starts[p], got = ends[p], None
                    break
                spots[p] = k
            if got is None:
                break
            going, now = bool(got), spots
            out += [(int(pool[k]), k, lap) for k in got]
            lap += bool(got)
        stay = [int(at[now[p]]) if now[p] < edges[p + 1] else ends[p] for p in range(len(sizes))]
        took = rows["id"].take(pa.array([k for _, k, _ in out] + [None] * len(sizes), pa.int64()))
        return pa.table({
            "pool": pa.array([p for p, *_ in out] + list(range(len(sizes))), pa.int32()), "id": took, "lap": pa.array([x for *_, x in out] + [lap] * len(sizes), pa.int64()),
            "at": pa.array([int(at[k]) for _, k, _ in out] + [max(a, b) for a, b in zip(stay, starts, strict=True)], pa.int64())})

    return run


def round_robin(df: DataFrame, pairs: list[tuple[str, Column]], total: int, id_col: str, seed: int) -> DataFrame:
    """id, pair, turn (from 0): rows dealt to the pairs, in order of their names, in turn, none twice, up to total.

    Rounds: each pool offers the next rows of its order, DEAL_ROWS in all, that no round has taken; one task deals as many laps as that allows. So a task's rows
    are bounded, rounds are about total / DEAL_ROWS, and rows that were taken are left out by an anti-join. A pair never gets beyond the first ``total`` rows of
    its pool: each row passed over was dealt to another.
    """
    pairs = sorted(pairs, key=lambda p: p[0])
    pools = in_ranges(heads(df, pairs, total, id_col, seed=seed).withColumn("one", F.lit(1)), F.col("pool"), F.col("rank"))
    pools = stored(running(pools, [F.col("pool"), F.col("rank")], "one", "at", ["pool"]).select("pool", F.col(id_col).alias("id"), F.col("at").cast("bigint").alias("at")), "places")
    n = {r.pool: r.n for r in pools.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    sizes, window = [n.get(p, 0) for p in range(len(pairs))], max(1, DEAL_ROWS // len(pairs))
    starts, lap, left, rounds = [0] * len(pairs), 0, total, []
    kind = pools.schema["id"].dataType.simpleString()
    while left > 0 and any(s < z for s, z in zip(starts, sizes, strict=True)):
        offered = pools.where(" or ".join(f"(pool = {p} and at >= {s} and at < {s + window})" for p, s in enumerate(starts)))
        for r in rounds:
            offered = offered.join(r.select("id"), "id", "left_anti")
        offered = offered.unionByName(df.sparkSession.range(1).select(F.lit(-1).alias("pool"), F.lit(None).cast(kind).alias("id"), F.lit(0).cast("bigint").alias("at")))  # so that there is a group
        step = stored(offered.groupBy(F.lit("round")).applyInArrow(laps(window, list(starts), sizes, lap, left), f"pool int, id {kind}, lap bigint, at bigint"), "laps")
        told = sorted(step.where("id is null").collect(), key=lambda r: r.pool)  # a row for each pool
        starts, lap = [r.at for r in told], told[0].lap
        rounds.append(step.where("id is not null"))
        left -= rounds[-1].count()
    dealt = df.sparkSession.createDataFrame([], f"pool int, id {kind}, lap bigint, at bigint")
    for r in rounds:
        dealt = dealt.unionByName(r)
    names = F.array(*[F.lit(n) for n, _ in pairs])
    numbered = row_numbers(dealt, [F.col("lap"), F.col("pool")], "turn").where(F.col("turn") <= total)
    return numbered.select(F.col("id").alias(id_col), F.get(names, F.col("pool")).alias("pair"), (F.col("turn") - 1).alias("turn"))


def greedy_labels(df: DataFrame, flags: list[tuple[str, Column]], per_label: int, id_col: str) -> DataFrame:
    """id, label, n_other: for each label in turn, the rows with fewest other labels that no earlier label took.

    A label never gets beyond the first per_label * (number of labels) rows of its pool.
    """
    others = (sum((F.when(c, 1).otherwise(0) for _, c in flags), F.lit(0)) - 1).alias("n_other")
    pools = stored(heads(df, flags, per_label * len(flags), id_col, others), "heads")
    dealt = claims(pools, id_col, per_label)
    names = F.array(*[F.lit(n) for n, _ in flags])
    found = dealt.join(pools, ["pool", id_col])
    return found.select(id_col, F.get(names, F.col("pool")).alias("label"), F.col("rank.n_other").alias("n_other"))


def remainder(df: DataFrame, taken: DataFrame, id_col: str) -> DataFrame:
    return df.join(taken.select(id_col), id_col, "left_anti")


# Rows of the first phase by stratum, for a pilot of 500 rows and, in the older plan, for any other size.
FIRST_PHASE = {"A_Random_Baseline": 50, "C_Boundary_Pairs": 10, "D_Hard_Cases": 4}
FIRST_PHASE_OTHER = {"A_Random_Baseline": 60, "C_Hard_Edge_Cases": 10}
COVERAGE, PILOT_ROWS, PHASE_ROWS, TWICE_LABELS = "B_Candidate_Coverage", 500, 100, 12


def phase_split(pilot: DataFrame, id_col: str, seed: int) -> DataFrame:
    """pilot (strata_label, candidate_label) with pilot_phase. Of 500 rows the first phase has fixed numbers by stratum, and two rows of each covered label.

    Other sizes: the older plan's numbers, two rows of twelve covered labels and one of the others, and what lacks to 100 rows from the rest.
    """
    designed = pilot.count() == PILOT_ROWS
    first = FIRST_PHASE if designed else FIRST_PHASE_OTHER
    number = F.lit(None).cast("int")
    for stratum, n in first.items():
        number = F.when(F.col("strata_label") == stratum, n).otherwise(number)
    rows = pilot.select(id_col, "strata_label", "candidate_label")
    covered = rows.where(F.col("strata_label") == COVERAGE)
    if designed:
        each = F.lit(2)
    else:
        labels = covered.select("candidate_label").distinct().orderBy(shuffle_key("candidate_label", seed)).limit(TWICE_LABELS)
        covered = covered.join(F.broadcast(labels.withColumn("twice", F.lit(True))), "candidate_label", "left")
        each = F.when(F.col("twice"), 2).otherwise(1)
    chosen = take_per_group(rows, ["strata_label"], number, id_col, seed).select(id_col).unionByName(take_per_group(covered, ["candidate_label"], each, id_col, seed).select(id_col))
    if not designed:
        chosen = stored(chosen, "chosen")
        lack = max(0, PHASE_ROWS - chosen.count())
        chosen = chosen.unionByName(remainder(rows, chosen, id_col).orderBy(shuffle_key(id_col, seed), id_col).limit(lack).select(id_col))
    return pilot.join(chosen.withColumn("pilot_phase", F.lit("Phase_1")), id_col, "left").withColumn("pilot_phase", F.coalesce("pilot_phase", F.lit("Phase_2")))


def pilot_set(df: DataFrame, id_col: str, seed: int, short: Column, topics: list[tuple[str, Column]], labels: list[tuple[str, Column]], pairs: list[tuple[str, Column]], quotas: DataFrame, keys: list[str],
              n_short: int = 10, n_multi: int = 10, n_pairs: int = 50, per_label: int = 10) -> DataFrame:
    """id, strata_label, sampling_method, candidate_label, candidate_reason of a pilot of four strata, no row in two of them.

    In this order: hard cases (short ones, then such of several topics), boundary pairs by round robin, candidates for each label, and a random baseline over a grid of quotas.
    """
    def told(rows, stratum, method, label=None, reason=None):
        none = F.lit("none")
        return rows.select(id_col, F.lit(stratum).alias("strata_label"), F.lit(method).alias("sampling_method"), (label if label is not None else none).alias("candidate_label"), (reason if reason is not None else none).alias("candidate_reason"))

    order = [shuffle_key(id_col, seed), F.col(id_col)]
    df = stored(df.where(F.col(id_col).isNotNull()), "rows")
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in topics]))
    parts = [stored(told(df.where(short).orderBy(*order).limit(n_short), "D_Hard_Cases", "D_Hard_Cases_VeryShort", reason=F.concat(F.lit("word_count: "), F.col("words").cast("string"))), "short")]
    rest = remainder(df, parts[0], id_col)
    multi = rest.withColumn("found", found).where(F.size("found") >= 2).orderBy(*order).limit(n_multi)
    parts.append(stored(told(multi, "D_Hard_Cases", "D_Hard_Cases_MultiTopic", reason=F.concat(F.lit("matched topics: "), F.array_join("found", ", "))), "multi"))
    rest = remainder(rest, parts[-1], id_col)
    dealt = round_robin(rest, pairs, n_pairs, id_col, seed)
    parts.append(stored(told(dealt, "C_Boundary_Pairs", "C_Boundary_Pairs", reason=F.concat(F.lit("boundary pair: "), F.col("pair"))), "pairs"))
    rest = remainder(rest, parts[-1], id_col)
    dealt = greedy_labels(rest, labels, per_label, id_col)
    parts.append(stored(told(dealt, COVERAGE, COVERAGE, label=F.col("label"), reason=F.concat(F.lit("other labels: "), F.col("n_other").cast("string"))), "labels"))
    rest = remainder(rest, parts[-1], id_col)
    grid = quota_grid(rest, quotas, keys, id_col, seed)
    cell = F.concat_ws(", ", *[F.concat(F.lit(f"{k}: "), F.col(k)) for k in keys])
    out = stored(told(grid, "A_Random_Baseline", "A_Random_Baseline", reason=cell), "grid")
    for p in parts:
        out = out.unionByName(p)
    return out
