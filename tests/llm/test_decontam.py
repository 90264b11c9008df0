import hashlib
import re
import time

from reactrix.llm import common, decontam

from .cases import awkward, empty, frame, prose

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "item_id bigint, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def slow_near(w, items, slop=2, least=11):
    found = set()
    for i, text in items:
        x = words(text)
        if i is None or len(x) < 13:
            continue
        for j in {*range(0, len(x) - 12, 13), len(x) - 13}:
            for s in range(-15, len(w) + 3):
                if sum(any(w[q] == x[j + k] for q in range(max(0, s + k - slop), min(len(w), s + k + slop + 1))) for k in range(13)) >= least:
                    found.add(str(i))
                    break
    return len(found)


def slow(docs, items):
    index = {}
    for i, text in items:
        w = words(text)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w and i is not None else 0):
            index.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in index}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in index:
                    found |= index[tuple(w[j : j + n])]
                    hit |= set(range(j, j + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), slow_near(w, items)))
    return sorted(out, key=repr)


def passages():
    p = [prose(k, 30) for k in range(50, 55)]
    items = [(k, t) for k, t in enumerate(p)] + [(10, "Eta, THETA iota"), (11, "zzz"), (12, None), (13, "!!"), (None, "alpha"), (14, p[0]), (15, p[1] + " tail words"), (16, "repeat " * 20), (16, "other text")]
    changed = p[0].split()
    for k in (3, 9, 16, 22, 28):  # a word of every passage is replaced, in every window of 13
        changed[k] = f"new{k}"
    inserted = p[1].split()
    inserted[6:6] = ["put", "in"]
    rows = awkward() + [
        (200, p[0], "en", "a", 1), (201, prose(60, 400) + " " + p[1], "en", "a", 1), (202, p[2].upper().replace(" ", " -- ") + prose(61, 30), "en", "a", 1), (203, " ".join(p[3].split()[:12]), "en", "a", 1),
        (204, " ".join(p[3].split()[5:20]), "en", "a", 1), (205, (p[4] + " ") * 30, "en", "a", 1), (206, "repeat " * 50, "en", "a", 1), (207, p[0] + " " + p[1] + " " + p[0], "en", "a", 1),
        (208, " ".join(changed), "en", "a", 1), (209, "so " + " ".join(inserted[2:]) + " far", "en", "a", 1), (210, " ".join(reversed(p[2].split())), "en", "a", 1), (211, " ".join(p[3].split()[1:12]), "en", "a", 1)]
    return rows, items


def check(spark):
    rows, items = passages()
    got = decontam.digest(frame(spark, rows), spark.createDataFrame(items, ITEM))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == slow([r[:2] for r in rows], items)
    return {r.doc_id: r for r in got.collect()}


def test_matches_brute_force(spark):
    got = check(spark)
    assert (got[208].n_hit, got[209].n_hit > 0) == (0, True) and got[208].n_near >= 2 and got[209].n_near >= 1 and got[210].n_near == 0


def test_candidates_beyond_the_broadcast(spark, monkeypatch):
    """Only texts with candidates are shuffled then: the others have no bit in the broadcast map."""
    monkeypatch.setattr(decontam, "BROADCAST_PLACES", -1)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    seen = []

    def kept(rows, small, same, how, n, *more):
        met = common.meet(rows, small, same, how, n, *more)
        seen.append((met.count(), small.count(), rows.count()))
        return met

    monkeypatch.setattr(decontam, "meet", kept)
    check(spark)
    assert seen[0][0] < seen[0][2]


def test_many_items_of_one_text(spark):
    """Items that share a text, or one window, each count; a word of a third of the corpus as an anchor beyond the broadcast."""
    p = prose(70, 40)
    items = [(k, p) for k in range(300)] + [(k, prose(k, 20) + " " + " ".join(p.split()[:13])) for k in range(300, 400)]
    rows = [(1, "so " + p, "en", "a", 1), (2, " ".join(p.split()[:13]), "en", "a", 1), (3, prose(71, 40), "en", "a", 1)]
    got = sorted([tuple(r) for r in decontam.digest(frame(spark, rows), spark.createDataFrame(items, ITEM)).collect()], key=repr)
    assert got == slow([r[:2] for r in rows], items) and [r[3] for r in got] == [400, 400, 0]


def test_hot_anchors_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    monkeypatch.setattr(common, "HOT_KEYS", 50)
    rows = [(k, "the " * (k % 7) + prose(k, 15) + " the of the", "en", "a", 1) for k in range(60)]
    items = [(1, "the of the"), (2, "the the the the"), (3, rows[5][1])]
    got = decontam.digest(frame(spark, rows), spark.createDataFrame(items, ITEM)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == slow([r[:2] for r in rows], items)


def test_bitmaps_keep_rows_without_partner_in_place(spark):
    docs = spark.range(5000).selectExpr("if(id = 7, null, id) as doc_id", "id as v")
    keys = spark.range(0, 5000, 50).selectExpr("if(id = 0, null, id) as of_doc", "id * 2 as extra")
    same, a, b = docs["doc_id"].eqNullSafe(keys["of_doc"]), common.F.xxhash64("doc_id"), common.F.xxhash64("of_doc")
    for how in ("inner", "left", "left_anti"):
        want = sorted(docs.join(keys, same, how).collect(), key=repr)
        assert sorted(common.meet(docs, keys, same, how, 100, a, b, limit=1).collect(), key=repr) == want
        assert sorted(common.meet(docs, keys, same, how, 100, a, b).collect(), key=repr) == want
    plan = common.meet(docs, keys, same, "left_anti", 100, a, b, limit=1)
    set_bits = plan.count() and common.meet(docs, keys, same, "inner", 100, a, b, limit=1).count()
    assert set_bits == 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEM)
    rows, items = passages()
    assert decontam.digest(empty(spark), spark.createDataFrame(items, ITEM)).count() == 0
    assert sorted([tuple(r) for r in decontam.digest(frame(spark, rows), none).collect()], key=repr) == slow([r[:2] for r in rows], [])


def test_long_repetitive_text(spark):
    n = 300_000
    docs = spark.createDataFrame([(1, "repeat " * n), (2, prose(1, 50))], "doc_id bigint, text string")
    items = spark.createDataFrame([(k, "repeat " * (20 + k)) for k in range(10)], ITEM)
    began = time.time()
    got = {r.doc_id: r for r in decontam.digest(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].n_near, got[2].n_hit) == (n, 10, 10, 0) and time.time() - began < 120
