import hashlib
import zlib

import pytest

from reactrix.llm import merkle as M

from .cases import awkward, empty, frame, prose


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def up(nodes):
    """(root, siblings of each node, level by level)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, p in enumerate(paths):
            run = at[k] // 3
            p.append(("".join(level[3 * run : at[k]]), "".join(level[at[k] + 1 : 3 * run + 3])))
            at[k] = run
        level = [h("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], paths


def slow(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = [up([leaf(*r) for r in by[s]]) for s in names]
    root, tops = up([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(names, trees, tops):
        for r, path in zip(by[s], paths):
            path = path + top
            now = leaf(*(r if r[0] is None or r[1] is None or zlib.crc32(str(r[0]).encode()) % 2 else (r[0], r[1].replace("\n", ""), *r[2:])))
            for left, right in path:
                now = h(left + now + right)
            out.append((r[0], leaf(*r), subroot, root, h("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=repr)


def rows(n=130):
    return awkward() + [(100 + k * 7 % 1000, prose(k, 1 + k % 9) + "\n" * (k % 3), "en", ["hot", "hot", "hot", "", "b", "ü", "z", "ZZ", None][k * k % 9], k) for k in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 6])
@pytest.mark.parametrize("ranged", [7, 20_000])
def test_equals_a_plain_tree(spark, monkeypatch, levels, ranged):
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "BLOCK", 3**levels)
    monkeypatch.setattr(M, "RANGE_ROWS", ranged)
    data = rows()
    got = sorted((tuple(r) for r in M.digest(frame(spark, data)).collect()), key=repr)
    assert got == slow(data)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_about_a_block(spark, monkeypatch, n):
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr(M, "BLOCK", 9)
    data = [(k, f"t{k}\n", None, "s", k) for k in range(n)]
    assert sorted((tuple(r) for r in M.digest(frame(spark, data)).collect()), key=repr) == slow(data)


def test_repeated_rows_have_places_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 10)
    data = [(5, "same", "en", "s", 4)] * 60 + [(None, None, None, None, None)] * 4
    got = sorted((tuple(r) for r in M.digest(frame(spark, data)).collect()), key=repr)
    assert got == slow(data)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)
    monkeypatch.setattr(M, "BLOCK", 3)
    data = [(k, "a\nb", "en", f"source {k % 40}", 1) for k in range(100)]
    assert sorted((tuple(r) for r in M.digest(frame(spark, data)).collect()), key=repr) == slow(data)


def test_empty(spark):
    assert M.digest(empty(spark)).count() == 0


def test_a_manifest_finds_what_was_changed(spark):
    data = rows(20)
    docs = frame(spark, data)
    from pyspark.sql import functions as F

    m = M.manifest(M.leaves(docs, F.when(F.col("doc_id") == 107, "another text").otherwise(F.col("text"))))
    found = M.proofs(m, spark).where(M.folded(F.col("now"), F.col("proof")) != F.col("root")).select("doc_id").collect()
    assert {r.doc_id for r in found} == {107}
