import random
import re

import numpy as np
import xxhash

from reactrix.llm import common, hamming, simhash

from .cases import awkward, empty, frame, prose

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(prints, radius=4):
    a, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def expected(rows):
    prints = [slow_print(r[1]) for r in rows]
    roots = slow_classes(prints)
    least = {}
    for r, k in zip(rows, roots):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return sorted(((r[0], f"{p:016x}", least.get(k)) for r, p, k in zip(rows, prints, roots)), key=repr)


def test_matches_brute_force(spark):
    rows = awkward()
    base = prose(9, 200).split()
    for k in range(40):  # near copies of one text
        words = base.copy()
        words[(k * 7) % 200] = f"w{k}"
        rows.append((100 + k, " ".join(words), "en", "a", 1))
    got = sorted([tuple(r) for r in simhash.near_duplicates(frame(spark, rows)).collect()], key=repr)
    assert got == expected(rows)
    assert any(r[2] is not None and r[0] != r[2] and r[0] and r[0] >= 100 for r in got)


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_index_finds_every_link_of_dense_and_sparse_blocks():
    rng = random.Random(5)
    for spread in (3, 6, 14, 30, 64):
        center = rng.getrandbits(64)
        some = set()
        for _ in range(900):
            x = center
            for _ in range(rng.randint(0, spread)):
                x ^= 1 << rng.randrange(64)
            some.add(x)
        fps = np.array(sorted(some), np.uint64)
        rank = fps.copy()
        for k in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(k)
        fps = fps[np.argsort(rank)]
        assert hamming.classes(fps, 4).tolist() == slow_classes(fps.tolist())


def test_tiles_of_hot_blocks_lose_no_link(spark):
    rng = random.Random(3)
    some = {rng.getrandbits(6) << 20 | rng.getrandbits(9) for _ in range(1500)}
    df = spark.createDataFrame([(x,) for x in some], "fp bigint")
    got = simhash.components(simhash.links(df, 4, tile=50)).collect()
    root = {r.u: r.root for r in got}
    fps = sorted(some)
    roots = slow_classes(fps)
    least = {}
    for x, k in zip(fps, roots):
        least[k] = min(least.get(k, x), x)
    assert {x: root.get(x, x) for x in fps} == {x: least[k] for x, k in zip(fps, roots)}


def test_more_segments_find_the_same_links():
    assert len(simhash.patterns(1000, 4)) == 5
    assert len(simhash.patterns(10**8, 4)) > 5
    for count in (10, 10**8, 10**10):
        masks = [m & (2**64 - 1) for m in simhash.patterns(count, 4)]
        rng = random.Random(1)
        for _ in range(300):  # any four changed bits leave a pattern whole
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(m & flips == 0 for m in masks)


def same_classes(spark, fps, **how):
    got = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), 4, **how)).collect()
    root, fps = {r.u: r.root for r in got}, sorted(fps)
    roots, least = slow_classes(fps), {}
    for x, k in zip(fps, roots, strict=True):
        least[k] = min(least.get(k, x), x)
    assert {x: root.get(x, x) for x in fps} == {x: least[k] for x, k in zip(fps, roots, strict=True)}


def crowd(n, seed=3, low=0, bits=40):
    """Fingerprints that share all bits outside one stretch."""
    rng = random.Random(seed)
    return sorted({0x5A << 50 | rng.getrandbits(bits) << low for _ in range(n)})


def test_crowded_patterns_are_split_and_lose_no_link(spark):
    rng = random.Random(9)
    some = crowd(300)
    some += [x ^ 1 << rng.randrange(60) ^ 1 << rng.randrange(60) for x in some[:100]]
    some += [1 << 45 | rng.getrandbits(9) for _ in range(200)]
    same_classes(spark, sorted(set(some)), tile=16, split=4)


def test_rows_of_a_crowded_pattern_grow_in_proportion(spark):
    """Four times the fingerprints of one pattern make about four times the rows of blocks, not sixteen times."""
    rows = [simhash.dealt(spark.createDataFrame([(x,) for x in crowd(n)], "fp bigint"), 4, 16, 4).count() / n for n in (1000, 4000)]
    assert rows[1] <= 1.6 * rows[0]
    blocks = simhash.dealt(spark.createDataFrame([(x,) for x in crowd(4000)], "fp bigint"), 4, 16, 4).groupBy("mask", "pattern", "a", "b").count()
    assert blocks.agg({"count": "max"}).first()[0] <= 6 * 16


def test_hot_classes_and_fingerprints(spark, monkeypatch):
    """Classes and copies above the bar of a hot key go back by the broadcast, the others by the shuffle, with the same result."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = awkward() + [(1000 + k, prose(4, 80) + f" x{k % 9}", "en", "a", 1) for k in range(60)] + [(None, "", "en", "a", 1)] * 6
    got = sorted([tuple(r) for r in simhash.near_duplicates(frame(spark, rows)).collect()], key=repr)
    assert got == expected(rows)


def test_long_texts_are_hashed_in_pieces():
    text = prose(8, 3000)
    assert hamming.fingerprint(text, 4) & (1 << 64) - 1 == hamming.fingerprint(text, 4, chunk=100) & (1 << 64) - 1 == slow_print(text)
    assert hamming.fingerprint("a b c d " * 40_000, 4) & (1 << 64) - 1 == slow_print("a b c d " * 40_000)


def test_a_struct_orders_the_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d e"), (None, "a b c d e"), (2, "A b c d e"), (9, "other words stand here now")], "doc_id bigint, text string").selectExpr("struct(doc_id is null as unknown, doc_id) as place", "text")
    got = {r.place.doc_id: r.component_id.doc_id for r in simhash.near_duplicates(docs, order="place").collect()}
    assert got == {3: 2, None: 2, 2: 2, 9: 9}
