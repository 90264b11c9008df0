import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from reactrix.llm import chunks
from reactrix.llm import pieces as P

from .cases import awkward, empty, frame, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(5)
    letters = [*"abcé .,\n\t▁漢字😀\x00�﻿ﬁＡ①́", "the ", " of", "ing", "  ", "<s>", "</s>", "<unk>", "<0x0A>", " " * 20]
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(300)]
    return [*made, " ", "  ", "▁", "▁▁a", "x" * 3000, "a" * 40_000, " " * 5000, prose(3, 9000), "\n" * 999]


def rows():
    return awkward() + [(1000 + k, t, "en", "s", 1) for k, t in enumerate(texts())] + [(2000, "again and again", "en", "s", 1)] * 50


def plain(t):
    ids = SP.encode(t or "", add_eos=True)
    return ids, SP.decode(ids)


@pytest.mark.parametrize("most", [0, 7, 1 << 18])
def test_equals_the_library(spark, most):
    got = P.decode(P.encode(frame(spark, rows()), PATH, most=most), PATH, keep=("doc_id", "ids")).collect()
    assert sorted([(r.doc_id, r.ids, r.decoded) for r in got], key=repr) == sorted([(r[0], *plain(r[1])) for r in rows()], key=repr)


def test_digest(spark):
    got = P.digest(frame(spark, rows()), PATH).collect()
    want = [(d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, (i, t) in ((r[0], plain(r[1])) for r in rows())]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert P.digest(empty(spark), PATH).count() == 0


def test_kept_columns_and_no_end(spark):
    got = P.encode(frame(spark, rows()), PATH, keep=("doc_id", "source", "size"), add_eos=False)
    assert got.columns == ["doc_id", "source", "size", "ids"]
    assert sorted([(r.doc_id, r.ids) for r in got.collect()], key=repr) == sorted([(r[0], SP.encode(r[1] or "")) for r in rows()], key=repr)


def test_any_ids_are_decoded_as_by_the_library(spark):
    rng = random.Random(3)
    some = [[], [2], [1, 1, 28705, 28705], [0, 0, 28705], [1] * 12 + [28705, 28709], [200, 201, 5], [130], None]
    some += [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32000), 28705]) for _ in range(rng.randrange(12))] for _ in range(400)]
    got = P.decode(spark.createDataFrame(list(enumerate(some)), "doc_id int, ids array<int>").repartition(3), PATH).collect()
    for r in got:
        ids = some[r.doc_id]
        assert r.decoded == (None if ids is None else SP.decode(ids)), ids


def test_the_table_has_the_most_frequent_chunks(spark):
    docs = spark.createDataFrame([(" ".join(f"w{k}" for k in range(60) for _ in range(60 - k)) + " " + "l" * 80,)] * 3, "text string")
    counts = P.chunk_counts(docs)
    n = {r.chunk: r.n for r in counts.collect()}
    assert n["▁w0"] == 180 and n["▁w59"] == 3 and "▁" + "l" * 80 not in n
    few = {r.chunk for r in P.frequent(counts, 20).collect()}
    assert 0 < len(few) <= 20 and min(n[c] for c in few) > max(n[c] for c in n if c not in few)
    assert {r.chunk: r.ids for r in P.chunk_table(counts, P.model_bytes(PATH)).collect()} == {c: SP.encode(c[1:]) for c in n}


def test_chunks_cut_every_text():
    for t in texts():
        assert "".join(chunks.cut(t)) == (chunks.MARK + t.replace(" ", chunks.MARK) if t else "")


def test_other_models_are_refused(tmp_path, monkeypatch):
    class Crossing(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, k):
            return "▁of▁the" if k == 5000 else super().id_to_piece(k)

    monkeypatch.setattr(P.sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="cross"):
        P.model_bytes(PATH)
