import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from reactrix.llm import common
from reactrix.llm import mixing as M

from .cases import awkward, empty, frame, prose


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: most * sizes[s] for s in full}
        full |= over


def rows():
    return awkward() + [(500 + k, prose(k, 20 + k % 37), "en", f"src{k * k % 7}", 1) for k in range(300)] + [(900, prose(1, 3), "en", "tiny", 1)]


def slow_mix(data, block, weights=(1, 2, 3), most=3):
    """(taken of each row, slots of each source in order): golden-ratio slots, ranks and blocks of words, one by one. Rows alike add up."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for r in data:
        total[r[3]] += size(r[1])
    aims = slow_targets(total, weights, most)
    words = {s: int(aims[s] + 0.5) for s in aims}
    names = sorted((s for s in words if s is not None and words[s])) + [None] * (None in words and words[None] > 0)
    whole, edges, at = sum(words.values()), [], 0
    for s in names:
        edges.append((round(at / whole * M.UNIT), round((at + words[s]) / whole * M.UNIT), s))
        at += words[s]
    slots = defaultdict(list)
    for i in range(-(-whole // block)):
        point = i * M.STEP % M.UNIT
        slots[next(s for lo, hi, s in edges if lo <= point < hi)].append(i)
    taken = defaultdict(int)
    for s in names:
        place = lambda r: (keys[(r[0], r[1])], r[0] is not None, r[0] or 0)
        keys = slow_mix.keys
        stream = [r for r in sorted((r for r in data if r[3] == s), key=place) for _ in range(size(r[1]))]
        quota = -(-words[s] // block)
        ranks = slots[s][:quota] + [None] * max(0, quota - len(slots[s]))
        for rank in range(len(ranks)):
            for k in range(rank * block, min((rank + 1) * block, words[s])):
                r = stream[k % len(stream)]
                taken[(r[0], r[1], s)] += 1
    return taken, slots


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_matches_brute_force(spark, block):
    data = rows()
    df = frame(spark, data)
    slow_mix.keys = {(r.doc_id, r.text): r.place for r in df.select("doc_id", "text", M.text_key(F.col("text")).alias("k")).withColumn("place", M.shuffled_place("doc_id", "k")).collect()}
    want, slots = slow_mix(data, block)
    got, of = defaultdict(int), {(M_key(r)): r[1] for r in data}
    for r in M.mix(df, block).withColumn("n", F.lit(1)).join(df.select(F.col("doc_id").alias("d"), M.text_key(F.col("text")).alias("k"), "text").distinct(), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))).collect():
        got[(r.doc_id, r.text, r.source)] += r.taken
    assert {k: v for k, v in got.items() if v} == dict(want) and of
    pieces = M.blocks(df, block).collect()
    by_slot = defaultdict(set)
    for p in pieces:
        by_slot[p.source].add((p.slot, p.rank))
    for s, found in by_slot.items():  # scheduled slots come in order of rank; closing slots follow them
        assert [x for x, _ in sorted(found, key=lambda y: y[1])][: len(slots[s])] == slots[s][: len(found)]
    assert sum(p.to_word - p.from_word for p in pieces) == sum(want.values())


def M_key(r):
    return r[0], r[1]


def test_points_are_exact_for_all_slots(spark):
    ids = [*range(50), *((1 << k) + d for k in (31, 32, 33, 45, 61) for d in (-1, 0, 1, 12345)), (1 << 62) - 1, 3_474_701_534]
    got = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", M.golden_point(F.col("i")).alias("p")).collect()
    assert [(r.i, r.p) for r in got] == [(i, i * M.STEP % M.UNIT) for i in ids]
    assert abs(M.STEP / M.UNIT - (5**0.5 - 1) / 2) < 1e-15


def test_schedule_far_beyond_32_bits(spark):
    aims = spark.createDataFrame([("a", 1000.0), ("b", 2500.0), (None, 300.0), ("c", 1.0)], "source string, target double")
    first, n = (1 << 33) + 17, 4000
    got = sorted(map(tuple, M.schedule(aims, n, first).collect()))
    edges, at = [], 0
    for s, words in (("a", 1000), ("b", 2500), ("c", 1), (None, 300)):
        edges.append((round(at / 3801 * M.UNIT), round((at + words) / 3801 * M.UNIT), s))
        at += words
    ranks, want = defaultdict(int), []
    for i in range(first, first + n):
        point = i * M.STEP % M.UNIT
        s = next(s for lo, hi, s in edges if lo <= point < hi)
        want.append((i, s, ranks[s]))
        ranks[s] += 1
    assert got == want


def test_targets_and_reruns(spark):
    data = rows()
    got = M.digest(frame(spark, data)).collect()
    assert len(got) == len(data)
    source, sizes = {}, defaultdict(int)
    for d, text, _, s, _ in data:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        source.setdefault((d, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))), s)
    want, taken = slow_targets(sizes), defaultdict(int)
    for r in got:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5, "every source, however small, gets its target"
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, M.digest(frame(spark, data).repartition(7)).collect()), key=repr)


def test_many_small_sources_and_ranges(spark, monkeypatch):
    """More sources than a range has rows, most of them smaller than a block, and one long document."""
    monkeypatch.setattr(common.in_ranges, "__defaults__", (100,))
    data = [(k, prose(k, 1 + k % 5), "en", f"w{k // 2}", 1) for k in range(700)] + [(5000, prose(1, 30_000), "en", "big", 1)]
    got = M.digest(frame(spark, data)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r[0]: r[3] for r in data}
    for r in got:
        s = source[r.doc_id]
        sizes[s], taken[s], target[s] = sizes[s] + r.size, taken[s] + r.taken, r.target
    want = slow_targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 0.5 and target[s] == pytest.approx(want[s]) for s in sizes) and len(sizes) == 351


def test_attach_keeps_columns(spark):
    df = frame(spark, rows())
    out = M.attach(df)
    assert (set(df.columns) - {"size"}) | {"own_size"} <= set(out.columns) and {r.own_size for r in out.collect()} == {"x"} and out.where("taken <= 0").count() == 0
    by_source = lambda x: {r.source: r.n for r in x.groupBy("source").agg(F.sum("taken").alias("n")).collect() if r.n}
    mixed = M.mix(df)
    # rows alike share an edge in whole words, so a few words can be missing
    a, b = by_source(out), by_source(mixed)
    assert a.keys() == b.keys() and all(0 <= b[s] - a[s] <= 2 for s in a)
    alone = lambda x: sorted((r.doc_id, r.taken) for r in x.where("doc_id >= 500 and taken > 0").select("doc_id", "taken").collect())
    assert alone(out) == alone(mixed)


def test_empty(spark):
    assert M.digest(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "en", "a", 1), (2, " ", "en", None, 1)], empty(spark).schema)
    assert [(r.size, r.target, r.taken) for r in M.digest(nothing).collect()] == [(0, 0.0, 0)] * 2
    assert M.blocks(nothing).count() == 0
