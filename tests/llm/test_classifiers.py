import random
import zlib

import numpy as np
import pytest

from reactrix.llm import grams, langid, linear, lm

from .cases import awkward, empty, frame, prose

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n=240):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(n):
        words, toxic, bad = prose(k, rng.randint(30, 120)).split(), k % 4 == 0, k % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moronic", "scumbag"]))
        if bad:
            words = [w.upper() + "!!" for w in words] if k % 2 else [w for w in words[:10] for _ in range(8)]
        rows.append((1000 + k, " ".join(words), ["en", "fr"][k % 2], "a", 1))
        labels.append((1000 + k, int(not bad), int(toxic)))
    return rows, labels


def check_scores(got, rows, labels, parts, held, cut, column):
    assert len(got) == len(rows)
    truth = {r[0]: r[column] for r in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == held)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert tested and np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.9


@pytest.mark.parametrize("run, parts, held, cut, column", [(linear.toxicity, 4, 2, 0.3, 2), (linear.quality, 3, 1, 0.5, 1)])
def test_linear(spark, run, parts, held, cut, column):
    rows, labels = corpus()
    rows += awkward()
    labelled = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), labels[0]], LABELS).selectExpr("*", "1 as text", "2 as y")
    got = run(frame(spark, rows), labelled).collect()
    check_scores(got, rows, labels, parts, held, cut, column)
    again = run(frame(spark, rows).repartition(5), labelled).collect()
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in got) == sorted((r.doc_id or -1, round(r.score, 6)) for r in again)


def test_linear_without_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in linear.toxicity(frame(spark, awkward()), none).collect()} == {0.5}
    assert linear.quality(empty(spark), none).count() == 0
    one = spark.createDataFrame([(4, 1, 1), (7, 1, 1), (8, 1, 1), (12, 1, 1)], LABELS)
    assert all(r.score > 0.9 for r in linear.quality(frame(spark, awkward()), one).collect())


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(80)
    flipped = [(d, 1 - q, 1 - t) if zlib.crc32(str(d).encode()) % 4 == 2 else (d, q, t) for d, q, t in labels]
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in linear.toxicity(frame(spark, rows), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, flipped))
    assert a == b


def test_whole_text_is_seen():
    f = grams.char_grams((3,), 16, True)
    text = "abc" * grams.PIECE + "xyz"
    seen = grams.Presence(16).distinct(f(text))
    assert set(seen) == set(grams.Presence(16).distinct(f("abcabcabcxyz")))
    assert set(grams.gram_index(grams.codes("xyz"), 3, 16)) <= set(seen)


def test_word_shapes():
    s = grams.word_shapes("the the The THE a!? #b #b")
    assert s[1] != s[0] and s[1] - s[0] == 16  # equal to the word before
    assert s[3] != s[2] and s[6] - s[5] == 16
    assert len(grams.word_shapes(" \n ")) == 0


def test_dual_descent_separates():
    rows = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])]
    for squared in (True, False):
        w = grams.dual_descent(rows, [1, 0, 1, 0], np.ones(3), np.ones(4), squared, 50)
        assert w[0] > 0 > w[1] and abs(w[2]) < 0.5


def test_language(spark):
    said = {"en": "the of and to in that with for", "fr": "le les des une dans pour que qui", "de": "der die und nicht mit sich auch ein"}
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(said[c].split()) + rng.choice(["", ",", "x"]) for _ in range(20)), c, "a", 1) for k in range(150) for c in [["en", "fr", "de"][k % 3]]]
    odd = [(900, None, "en", "a", 1), (901, "123 !!", "en", "a", 1), (902, "", None, "a", 1), (None, "the of and", None, None, None), (903, "le les des " * 50_000, None, "a", 1)]
    got = langid.language(frame(spark, rows + odd)).collect()
    truth = {r[0]: r[2] for r in rows}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert tested and all(r.lang_pred == truth[r.doc_id] for r in tested)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0
    assert by[903].lang_pred == "fr" and by[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    assert langid.language(empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.language(frame(spark, [(1, "text", None, "a", 1)])).collect()} == {"und"}


def slow_loss(texts, low, size, order, strength, vocabulary):
    """Interpolated loss per token of ``low`` under the counts of texts."""
    from collections import Counter

    ids = lambda t: [0] * (order - 1) + [vocabulary.get(c, 1) for c in t.lower()]
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = ids(t)
        for i in range(order - 1, len(s)):
            for n in range(1, order + 1):
                counts[n][tuple(s[i - n + 1 : i + 1])] += 1
    total = sum(counts[1].values())
    s, loss = ids(low), 0.0
    for i in range(order - 1, len(s)):
        p = (counts[1][(s[i],)] + 1) / (total + size)
        for n in range(2, order + 1):
            gram = tuple(s[i - n + 1 : i + 1])
            context = sum(v for g, v in counts[n].items() if g[:-1] == gram[:-1])
            p = (counts[n][gram] + strength * p) / (context + strength)
        loss -= np.log(p)
    return loss / len(low)


def test_language_model_matches_brute_force(spark):
    docs = [(1, "abab abc", True), (2, "cabbage bad", False), (3, "Abba", True), (4, "", False), (5, None, True), (None, "xyz", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, target boolean")
    model = lm.train(df, size=4)
    got = {r.doc_id: r for r in lm.score(df, model).collect()}
    table = {c: int(model[0][ord(c)]) for c in "abcdefgxyz "}
    vocabulary = {c: v for c, v in table.items() if v > 1}
    assert len(vocabulary) == 4
    for d, text, _ in docs:
        if text:
            target = slow_loss([t for _, t, y in docs if y and t], text, 6, lm.ORDER, lm.STRENGTH, vocabulary)
            background = slow_loss([t for _, t, _ in docs if t], text, 6, lm.ORDER, lm.STRENGTH, vocabulary)
            assert got[d].score == pytest.approx(target - background, abs=1e-5) and got[d].n_tokens == len(text)
    assert got[4].score is None and got[5].score is None and got[4].n_tokens == 0


def test_language_model_query(spark):
    rows, labels = corpus(60)
    got = lm.cross_entropy_difference(frame(spark, rows + awkward()), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) + len(awkward())
    good = {d for d, q, _ in labels if q}
    scored = [(r.score, r.doc_id in good) for r in got if r.doc_id and r.doc_id >= 1000]
    assert np.mean([s for s, g in scored if g]) < np.mean([s for s, g in scored if not g])
    assert lm.cross_entropy_difference(empty(spark), spark.createDataFrame([], LABELS)).count() == 0


def scripts():
    """A Latin corpus beside Cyrillic, Han and beyond-16-bit texts: more distinct characters than a fixed vocabulary has room for."""
    rng = random.Random(5)
    latin = [(k, prose(k, 40), k % 2 == 0) for k in range(40)]
    cyrillic = [(100 + k, "".join(rng.choice("абвгдежз" if k % 2 else "ийклмноп") for _ in range(60)), k % 2 == 0) for k in range(10)]
    han = [(200 + k, "".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(80)) + "\U0001D4B3", k % 2 == 0) for k in range(10)]
    return latin + cyrillic + han + [latin[0], (None, None, None), (300, "", False)]


def check_open_model(spark):
    docs = scripts()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, target boolean")
    model = lm.train(df)
    letters = {c for _, t, _ in docs for c in (t or "").lower()}
    vocabulary = {c: int(model[0][ord(c)]) for c in letters}
    assert len(letters) > 300 and len(set(vocabulary.values())) == len(letters) and min(vocabulary.values()) > 1
    counted = sorted(map(tuple, lm.score(df, model, counted=True).collect()), key=repr)
    found = lm.score(df, model).collect()
    assert len(found) == len(docs) and [c[:2] for c in counted] == [r[:2] for r in sorted(map(tuple, found), key=repr)]
    got = {r.doc_id: r for r in found}
    of_target, of_all, size = [t for _, t, y in docs if y and t], [t for _, t, _ in docs if t], len(letters) + 2
    for d in (0, 100, 101, 205):
        text = next(t for i, t, _ in docs if i == d)
        target, background = (slow_loss(x, text, size, len(model[2]), lm.STRENGTH, vocabulary) for x in (of_target, of_all))
        assert (got[d].target_loss, got[d].background_loss) == pytest.approx((target, background), abs=1e-5) and got[d].n_tokens == len(text)
    assert got[100].score < 0 < got[101].score  # letters of the target, and letters that it never has
    new = spark.createDataFrame([(1, "жук ßx 一二 zz"), (2, None)], "doc_id bigint, text string")
    one = {r.doc_id: r for r in lm.score(new, model).collect()}
    assert one[1].target_loss == pytest.approx(slow_loss(of_target, "жук ßx 一二 zz", size, len(model[2]), lm.STRENGTH, vocabulary), abs=1e-5) and one[2].score is None


def test_language_model_has_an_open_vocabulary(spark):
    check_open_model(spark)


def test_language_model_joins_grams_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARED_GRAMS", 50)
    check_open_model(spark)


@pytest.mark.parametrize("single,pair", [(5, 40), (40, 18)])
def test_rare_characters_are_two_tokens_at_the_same_order(spark, monkeypatch, single, pair):
    docs = scripts()
    monkeypatch.setattr(lm, "SINGLE", single)
    monkeypatch.setattr(lm, "PAIR", pair)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, target boolean")
    model = lm.train(df)
    tokens = lambda t: [x for c in t.lower() for v in [int(model[0][ord(c)])] for x in ([v] if v > 0 else [-v >> 13, -v & 8191])]
    letters = {c for _, t, _ in docs for c in (t or "").lower()}
    spelt = {tuple(tokens(c)) for c in letters}
    assert len(spelt) == len(letters) and sum(len(x) == 1 for x in spelt) == single and max(max(x) for x in spelt) == model[1] - 1
    assert not {x[0] for x in spelt if len(x) == 1} & {y for x in spelt if len(x) == 2 for y in x}
    # a text of tokens is told by private letters, so that the plain version sees one letter for a token
    as_text = lambda t: "".join(chr(0xE000 + x) for x in tokens(t))
    vocabulary = {chr(0xE000 + x): x for x in range(2, model[1])}
    got = {r.doc_id: r for r in lm.score(df, model, counted=True).collect()}
    of_target, of_all = [as_text(t) for _, t, y in docs if y and t], [as_text(t) for _, t, _ in docs if t]
    for d in (0, 101, 205):
        text = as_text(next(t for i, t, _ in docs if i == d))
        assert got[d].n_tokens == len(text) and len(model[2]) == lm.ORDER
        assert (got[d].target_loss, got[d].background_loss) == pytest.approx(tuple(slow_loss(x, text, model[1], lm.ORDER, lm.STRENGTH, vocabulary) for x in (of_target, of_all)), abs=1e-5)


def test_the_order_is_the_same_with_thousands_of_characters(spark):
    docs = [(k, prose(k, 30), k % 2 == 0) for k in range(12)]
    wide = [(500 + k, "".join(chr(0x4E00 + 300 * k + j) for j in range(300)), False) for k in range(20)]
    few, many = (lm.train(spark.createDataFrame(x, "doc_id bigint, text string, target boolean")) for x in (docs, docs + wide))
    assert len(few[2]) == len(many[2]) == lm.ORDER and many[1] < 5404 < len(wide) * 300 and many[1] ** lm.ORDER < 1 << 62
    every = -(-(0x110000 - lm.SINGLE) // lm.PAIR)
    assert every <= lm.PAIR and (2 + lm.SINGLE + every + lm.PAIR) ** lm.ORDER < 1 << 62 and 2 + lm.SINGLE + every + lm.PAIR < 1 << 13
    df = spark.createDataFrame(docs, "doc_id bigint, text string, target boolean")
    score = lambda m: [r.score for r in lm.score(df, m).orderBy("doc_id").collect()]
    assert np.corrcoef(score(few), score(many))[0, 1] > 0.99


def test_long_texts_keep_their_context_over_pieces(monkeypatch):
    table = np.ones(300, np.int32)
    table[97:120] = np.arange(2, 25)
    table[120:123] = [-(30 << 13 | 40), -(30 << 13 | 41), -(31 << 13 | 40)]
    text = "axbyczabcxyz" * 9
    whole = np.concatenate([grams.gram_cells(t, 50, 5) for t in grams.tokens(text, table, 4)])
    monkeypatch.setattr(grams, "PIECE", 7)
    assert np.array_equal(whole, np.concatenate([grams.gram_cells(t, 50, 5) for t in grams.tokens(text, table, 4)]))


def test_language_fit_is_bounded_and_equals_a_plain_one(spark, monkeypatch):
    rng = random.Random(8)
    words = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 7))) for _ in range(15)] for k in range(40)}
    rows = [(k * 40 + j, " ".join(rng.choice(words[c]) for _ in range(30)), c, "a", 1) for k in range(30) for j, c in enumerate(words)]
    monkeypatch.setattr(langid, "SAMPLE", 400)
    monkeypatch.setattr(langid, "MARKS", 120)
    monkeypatch.setattr(langid, "ROWS", 64)
    docs = frame(spark, rows)
    packed, solved, names = langid.train(docs)
    assert names == sorted(words) and len(packed) <= 120 and solved.shape == (len(packed), 40)
    got = {r.doc_id: r for r in langid.identify(docs, (packed, solved, names)).collect()}
    held = [r for r in got.values() if r.held_out]
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9
    # presence kernel, landmarks and argmax, one text at a time
    marks = [set(np.flatnonzero(np.unpackbits(m))) for m in packed]
    for doc_id, text, *_ in rows[::97]:
        own = set(np.flatnonzero(grams.presence_matrix([text], langid.ORDERS, langid.BITS)[0]))
        similar = np.array([len(own & m) / np.sqrt(len(own) * len(m)) for m in marks])
        assert got[doc_id].lang_pred == names[int(np.argmax(similar @ solved))]


def test_gram_counts_are_handed_on_whole():
    import pyarrow as pa

    texts = [prose(k, 50) for k in range(6)]
    table = np.arange(256, dtype=np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([k % 2 == 0 for k in range(6)])], ["text", "target"])
    sums = []
    for most in (1 << 20, 100):
        total = {}
        for out in grams.gram_counts(table, 256, 3, most)(iter([batch])):
            for c, t, b in zip(*[out.column(k).to_pylist() for k in range(3)], strict=True):
                total[c] = tuple(np.add(total.get(c, (0, 0)), (t, b)))
        sums.append(total)
    assert sums[0] == sums[1] and sum(b for _, b in sums[0].values()) == sum(map(len, texts))


def test_letters_are_unicode_letters(spark):
    """Numbers, marks and signs that \\w matches are no letters; letters of every script are."""
    none = ["½ ²", "ⅷ", "½ ² ⅷ", "\u0301\u0308", "🙂 👍", "١٢٣", "_ 12", "〇", "³"]
    some = ["ß", "ñ ½", "文", "ﬁ", "ª", "ʰ", "а1"]
    rows = [(k, "the of and to in that " * 4, "en", "a", 1) for k in range(12)] + [(100 + k, t, None, "a", 1) for k, t in enumerate(none)] + [(200 + k, t, None, "a", 1) for k, t in enumerate(some)]
    got = {r.doc_id: r for r in langid.language(frame(spark, rows)).collect()}
    assert [(got[100 + k].lang_pred, got[100 + k].score) for k in range(len(none))] == [("und", 0.0)] * len(none)
    assert {got[200 + k].lang_pred for k in range(len(some))} == {"en"}


def test_language_sample_takes_a_text_once(spark, monkeypatch):
    rows = [(k, "le les des une dans", "fr", "a", 1) for k in range(300)] + [(1000 + k, f"the of and word{k}", "en", "a", 1) for k in range(60)]
    packed, solved, names = langid.train(frame(spark, rows), per_lang=10, landmarks=50)
    assert names == ["en", "fr"] and len(packed) <= 10 + 1


def slow_grams(text, orders, bits):
    """Buckets of character n-grams, one at a time."""
    text, found = f" {text.lower()} ", set()
    for n in orders:
        for i in range(len(text) - n + 1):
            h = (ord(text[i]) + n * 0x9E3779B1) % 2**32
            for c in text[i + 1 : i + n]:
                h = h * 0x01000193 % 2**32 ^ ord(c)
            h = (h ^ h >> 15) * 2654435769 % 2**32
            found.add(h >> 32 - bits)
    return found


@pytest.mark.parametrize("squared", [True, False])
def test_linear_model_matches_brute_force(spark, squared):
    """Counts, ratios, the dual descent over all n-grams, its calibration and the scores, against a plain dense version."""
    rows, labels = corpus(90)
    s = linear.Settings("toxic", 4, 2, 0.3, grams.char_grams((3, 4), 12, True), 12, squared, cost=0.05, epochs=400, smooth=1.0)
    model = linear.train(frame(spark, rows), spark.createDataFrame(labels, LABELS), s)
    truth = {d: t for d, _, t in labels}
    taught = [(d, slow_grams(t, (3, 4), 12), truth[d]) for d, t, *_ in rows if zlib.crc32(str(d).encode()) % 4 != 2]
    n = [sum(y == c for *_, y in taught) for c in (0, 1)]
    ratio = np.zeros(1 << 12)
    for b in set().union(*(x for _, x, _ in taught)):
        p = [(sum(b in x for _, x, y in taught if y == c) + 1) / (n[c] + 2) for c in (0, 1)]
        ratio[b] = np.log(p[1] / p[0])
    x = np.zeros((len(taught), (1 << 12) + 1))
    for k, (_, found, _) in enumerate(taught):
        x[k, sorted(found)] = ratio[sorted(found)]
    x[:, -1] = 1
    sign = np.array([1.0 if y else -1.0 for *_, y in taught])
    cost = 0.05 * np.where(sign > 0, 0.5 / (n[1] / len(taught)), 0.5 / (n[0] / len(taught)))
    alpha = np.zeros(len(taught))  # the dual, by plain coordinate steps in order
    q = (x * sign[:, None]) @ (x * sign[:, None]).T + np.diag(0.5 / cost if squared else 0 * cost)
    for _ in range(3000):
        for i in range(len(alpha)):
            alpha[i] = min(max(0.0, alpha[i] - (q[i] @ alpha - 1) / q[i, i]), np.inf if squared else cost[i])
    w = x.T @ (alpha * sign)
    assert model.weights == pytest.approx(w[:-1] * ratio, abs=2e-3) and model.bias == pytest.approx(w[-1], abs=2e-3)
    got = {r.doc_id: r.score for r in linear.score(frame(spark, rows), model, s).collect()}
    for d, text, *_ in rows:
        m = sum((w[:-1] * ratio)[b] for b in slow_grams(text, (3, 4), 12)) + w[-1]
        assert got[d] == pytest.approx(1 / (1 + np.exp(-(model.a * m + model.b))), abs=2e-2)


def test_sample_is_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([k % 2 for k in range(50)], pa.int32()), pa.array([np.array([k % 2, 2], np.int32).tobytes() for k in range(50)], pa.binary())], ["y", "x"])
    few, places, whole = (np.frombuffer(next(grams.fit(np.ones(3), 1.0, False, 20, *bound)(iter([batch]))).column(0)[0].as_py(), np.float32) for bound in ((10, 1 << 20), (1000, 20), (50, 1 << 20)))
    assert few.tolist() == places.tolist() and few[1] > 0 > few[0] and whole[1] > 0 > whole[0]


def test_kernel_matches_brute_force():
    texts = ["the cat", "le chat", "the dog and the cat", "x"]
    m = grams.presence_matrix(texts, (1, 2, 3), 14)
    sets = [slow_grams(t, (1, 2, 3), 14) for t in texts]
    k = grams.kernel(m, m[:2])
    for i, a in enumerate(sets):
        assert set(np.flatnonzero(m[i])) == a
        for j, b in enumerate(sets[:2]):
            assert k[i, j] == pytest.approx(len(a & b) / np.sqrt(len(a) * len(b)))


def test_finder_has_all_keys_and_no_others():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 60, 50_000))
    find, other = grams.finder(keys, 1 << 61), rng.integers(0, 1 << 60, 20_000)
    assert (find(keys) == np.arange(len(keys))).all()
    assert ((find(other) >= 0) == np.isin(other, keys)).all()
    assert (grams.finder(keys[:0], 1 << 61)(other) == -1).all() and len(find(other[:0])) == 0
