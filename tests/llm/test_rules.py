import re
from collections import Counter

from reactrix.llm import quality_rules as Q

from .cases import awkward, empty, frame, prose


def slow(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    at = {p for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(at), len(w) < 50 or 100 * len(at) > 50 * len(w)


def test_matches_brute_force(spark):
    rows = awkward() + [(20, "a b a b a b a", "en", "a", 1), (21, "a a a", "en", "a", 1), (22, "a a a a", "en", "a", 1), (23, prose(5, 60) + " " + prose(5, 60), "en", "a", 1)]
    got = Q.digest(frame(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted([(r.doc_id, *[r[n] for n in names]) for r in got], key=repr) == sorted([(r[0], *slow(r[1])) for r in rows], key=repr)
    assert all(not r.kept for r in got if r.base_failed)
    assert {r.doc_id for r in got if r.kept} >= {7}
    assert not {r.doc_id for r in got if r.kept} & {10, 11, 12}


def test_empty_and_ablations(spark):
    assert Q.digest(empty(spark)).count() == 0
    ledger = Q.ledger(frame(spark, awkward()))
    bits = [r.failed for r in ledger.collect()]
    for r in Q.ablations(ledger, "v1").collect():
        b = Q.BIT[r.rule]
        assert r.n_failed == sum(bool(x & b) for x in bits)
        assert r.n_kept == sum(not x & Q.POLICIES["v1"] for x in bits)
        assert r.n_kept_without == sum(not x & Q.POLICIES["v1"] & ~b for x in bits)
    assert all(r.n_kept == 0 for r in Q.ablations(Q.ledger(empty(spark))).collect())
