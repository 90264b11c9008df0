"""Samplers against a dealer who goes over the rows one by one."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from reactrix.operators import sampling as S


def rows(n=300, labels=18, share=0.25):
    rng = random.Random(4)
    return [(k, sum(1 << j for j in range(labels) if rng.random() < share)) for k in range(n)]


def key(k):
    return hashlib.md5(f"42:{k}".encode()).hexdigest()


def flags(n):
    return [(f"p{j:02d}", F.col("m").bitwiseAND(F.lit(1 << j)) != 0) for j in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id bigint, m bigint").repartition(3)


def dealer(data, n, total):
    pools = [sorted([k for k, m in data if m >> j & 1], key=key) for j in range(n)]
    used, out, at = set(), [], [0] * n
    while len(out) < total:
        before = len(out)
        for j in range(n):
            while len(out) < total and at[j] < len(pools[j]):
                x = pools[j][at[j]]
                at[j] += 1
                if x not in used:
                    used.add(x)
                    out.append((x, f"p{j:02d}", len(out)))
                    break
        if before == len(out):
            break
    return out


@pytest.mark.parametrize("total,offered", [(50, 200_000), (280, 200_000), (280, 400), (30, 48), (1, 200_000)])
def test_round_robin_over_eight_pairs(spark, monkeypatch, total, offered):
    monkeypatch.setattr(S, "DEAL_ROWS", offered)
    data = rows()
    got = S.round_robin(frame(spark, data), flags(8), total, "id", 42).orderBy("turn").collect()
    assert [tuple(r) for r in got] == dealer(data, 8, total)


def test_round_robin_with_empty_and_ending_pools(spark, monkeypatch):
    monkeypatch.setattr(S, "DEAL_ROWS", 30)
    data = [(k, 1 if k < 3 else 4 if k % 2 else 5) for k in range(60)]  # pool 1 is empty, pool 2 has most
    got = S.round_robin(frame(spark, data), flags(3), 100, "id", 42).orderBy("turn").collect()
    assert [tuple(r) for r in got] == dealer(data, 3, 100)
    assert S.round_robin(frame(spark, []), flags(3), 10, "id", 42).count() == 0
    words = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "id string, m bigint")
    assert {r.id for r in S.round_robin(words, flags(2), 10, "id", 42).collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("per", [1, 10, 40])
def test_greedy_over_eighteen_labels(spark, per):
    data, used, want = rows(), set(), []
    for j in range(18):
        pool = sorted((bin(m).count("1") - 1, k) for k, m in data if m >> j & 1)
        took = [x for x in pool if x[1] not in used][:per]
        used |= {x[1] for x in took}
        want += [(k, f"p{j:02d}", n) for n, k in took]
    assert sorted(tuple(r) for r in S.greedy_labels(frame(spark, data), flags(18), per, "id").collect()) == sorted(want)


@pytest.mark.parametrize("edge,digits", [(1_000_000, 3), (20, 1), (1, 1)])
def test_quotas_of_a_hot_group(spark, monkeypatch, edge, digits):
    monkeypatch.setattr(S, "EDGE_ROWS", edge)
    monkeypatch.setattr(S, "DIGITS", digits)
    group = lambda k: None if k % 9 == 0 else "hot" if k % 9 < 6 else "b" if k % 2 else "c"
    quota = {None: 7, "hot": 100, "b": 5000, "c": 0}
    df = spark.createDataFrame([(k, group(k)) for k in range(900)], "id bigint, g string").repartition(4)
    column = F.when(F.col("g").isNull(), 7).when(F.col("g") == "hot", 100).when(F.col("g") == "b", 5000)
    got = S.take_per_group(df, ["g"], column, "id", 42).collect()
    want = [(k, g) for g, n in quota.items() for k in sorted((k for k in range(900) if group(k) == g), key=key)[:n]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_task_ranks_a_whole_group(spark):
    df = spark.range(60_000).select(F.col("id"), F.lit("hot").alias("g"))
    plan = S.take_per_group(df, ["g"], F.lit(20_000), "id", 1)
    assert plan.count() == 20_000
    ranked = plan._jdf.queryExecution().executedPlan().toString()
    assert "__edge" in ranked and ranked.count("Window [row_number") <= 1
    hist = df.groupBy(F.substring(S.shuffle_key("id", 1), 1, S.DIGITS)).count().agg(F.max("count")).first()[0]
    assert hist < 60, "of 60,000 rows only those that share three digits of the hash meet in one window"


def test_phases_of_a_designed_and_another_pilot(spark):
    strata = [("A_Random_Baseline", "none")] * 250 + [("B_Candidate_Coverage", f"T{k % 18:02d}") for k in range(180)] + [("C_Boundary_Pairs", "none")] * 50 + [("D_Hard_Cases", "none")] * 20
    full = spark.createDataFrame([(k, s, c) for k, (s, c) in enumerate(strata)], "id bigint, strata_label string, candidate_label string")
    first = S.phase_split(full, "id", 1).where("pilot_phase = 'Phase_1'").groupBy("strata_label").count().collect()
    assert {r.strata_label: r["count"] for r in first} == {"A_Random_Baseline": 50, "B_Candidate_Coverage": 36, "C_Boundary_Pairs": 10, "D_Hard_Cases": 4}
    other = S.phase_split(full.where("id < 490"), "id", 1)
    assert other.count() == 490 and other.where("pilot_phase = 'Phase_1'").count() == 100
    by = {r.candidate_label: r["count"] for r in other.where("pilot_phase = 'Phase_1' and strata_label = 'B_Candidate_Coverage'").groupBy("candidate_label").count().collect()}
    assert len(by) == 18 and sum(n >= 2 for n in by.values()) >= 12
    assert S.phase_split(full.where("id < 40"), "id", 1).where("pilot_phase = 'Phase_1'").count() == 40


def test_no_row_is_in_two_strata(spark):
    data = [(k, m, k % 40) for k, m in rows(900)]
    df = spark.createDataFrame(data, "id bigint, m bigint, words int").withColumn("kind", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    quotas = spark.createDataFrame([("x", 100), ("y", 150), ("z", 5)], "kind string, quota int")
    p = S.pilot_set(df, "id", 7, F.col("words") <= 2, flags(17), flags(18), flags(8), quotas, ["kind"]).collect()
    assert len(p) == len({r.id for r in p}) == 10 + 10 + 50 + 180 + 250
    labels = {}
    for r in p:
        labels.setdefault(r.candidate_label, []).append(r.strata_label)
    assert all(v == ["B_Candidate_Coverage"] * 10 for k, v in labels.items() if k != "none") and len(labels) == 19
