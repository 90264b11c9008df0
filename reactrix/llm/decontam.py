"""Benchmark decontamination by a distributed positional inverted index.

1. One pass over the corpus counts the benchmark's own terms.
2. Every distinct benchmark window (``width`` consecutive words, or a whole shorter item) names its two rarest terms, its anchors.
3. A second pass stores the postings ``(term, document, position)`` of the anchors, the positional index, and the documents' lengths.
4. Postings are shifted by the anchor's place in the item. Where both anchors of a window meet at one shift, the
   document may hold the window there.
5. Documents with such places are read once more, and the words there are looked up among the windows.

Pruning in 2-4 is exact: a document that holds a window holds its two rarest terms at that window's shift.

Proximity matches come from the same index. An item's passages are its consecutive windows of ``width`` words side by side, and the last
one. A document is near a passage if, for some shift, at least ``least`` of the passage's words each stand within ``slop`` words of their place:
words may be changed, left out, put in or swapped. With up to width - least words missing, two of the width - least + 2 rarest must be there, so
these are the passage's anchors, and a place where two of them meet within the slop is compared in full. A term that the corpus
lacks is one that is missing there. Shorter items have exact matches only.

Texts go nowhere: what travels is anchors, postings of anchors, and the texts of documents that have candidates, if these are too many to broadcast.
Items are named last: a document's distinct windows become distinct word sequences, and these become items, in rows of one each, so a window or a text
that a third of all items share is no row of its own size. Only a document's own list of items is put together. Tables of the benchmark are broadcast if
their measured bytes are within BROADCAST_BYTES; else frequencies are summed before terms meet them, and postings meet frequent anchors by a broadcast of these alone.

Defined results: null and empty texts have no words; a null item_id is ignored; an item without words has no window; repeated document
rows each get the same row of results; repeated items count once per item_id; of equally rare terms the first is taken; very long texts are read whole, and a window found many
times in one costs in proportion; extra columns are left out; empty inputs give empty results (an empty benchmark gives zero hits). Columns other than doc_id, text and item_id are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_TOKEN, clean_of, let, lower_ascii, materialize, meet, split_words, spread_join, text_key

#: Candidate places that may be broadcast with their documents' ids, and the bytes of a table of the benchmark that may be.
BROADCAST_PLACES, BROADCAST_BYTES = 1_000_000, 128 << 20
#: Windows of an item that share a set of anchors: two bits each at most, in 64.
PIECE = 25


def contract_words(text):
    return split_words(lower_ascii(text), NON_TOKEN)


def is_light(df: DataFrame) -> bool:
    """Whether all rows, each as JSON and 64 bytes more, are within BROADCAST_BYTES."""
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 64)).first()[0] or 0) <= BROADCAST_BYTES


def light(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_light(df) else df


def members(items: DataFrame) -> DataFrame:
    """seq, words, item_id of each item that has words; items of one text share its sequence."""
    rows = (
        clean_of(items, "item_id", "text").where("item_id is not null")
        .select(F.col("item_id").cast("string").alias("item_id"), contract_words(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
    )
    return rows.select(F.md5(F.array_join("words", " ")).alias("seq"), "words", "item_id")


def windows(seqs: DataFrame, starts: Column, width: int) -> DataFrame:
    """window (a digest of its words), seq, start, span: every place where one stands."""
    rows = seqs.withColumn("span", F.least(F.size("words"), F.lit(width))).select("seq", "span", "words", F.explode(starts).alias("start"))
    return rows.select(F.md5(F.array_join(F.slice("words", F.col("start") + 1, F.col("span")), " ")).alias("window"), "seq", "start", "span")


def distinct_windows(places: DataFrame) -> DataFrame:
    """window, seq, start, span: each window with one place where it stands."""
    return places.groupBy("window").agg(F.min(F.struct("seq", "start", "span")).alias("at")).select("window", "at.*")


def every_start() -> Column:
    return F.sequence(F.lit(0), F.size("words") - F.col("span"))


def side_by_side(width: int) -> Column:
    last = F.size("words") - width
    return F.when(last >= 0, F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(width)), F.array(last)))).otherwise(F.expr("cast(array() as array<int>)"))


def corpus_frequencies(docs: DataFrame, seqs: DataFrame) -> DataFrame:
    """term, freq over all documents, of the terms that items have."""
    vocabulary = materialize(seqs.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    tokens = clean_of(docs, "text").select(F.explode(contract_words(F.col("text"))).alias("term"))
    if is_light(vocabulary):
        return tokens.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq"))
    return tokens.groupBy("term").agg(F.count("*").alias("freq")).join(vocabulary, "term", "left_semi")  # summed where the texts are, so no term is hot


def with_rarest(wins: DataFrame, seqs: DataFrame, freqs: DataFrame, n: int) -> DataFrame:
    """wins with words (of the window) and rare: (freq, place in the item) of its n rarest terms, rarest first."""
    ranked = (
        seqs.select("seq", F.posexplode("words").alias("place", "term"))
        .join(freqs, "term", "left")
        .groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("freq", F.lit(0)).alias("freq")))).alias("places"))
    )
    rows = wins.join(seqs.select("seq", F.col("words").alias("all")), "seq").join(ranked, "seq")
    inside = F.transform(F.slice("places", F.col("start") + 1, F.col("span")), lambda x: F.struct(x["freq"].alias("freq"), x["place"].alias("place")))
    return rows.withColumn("words", F.slice("all", F.col("start") + 1, F.col("span"))).withColumn("rare", F.slice(F.sort_array(inside), 1, n)).drop("places")


def anchored_pieces(ranked: DataFrame) -> DataFrame:
    """piece, places, terms, wins: windows of one item that lie close together, their anchors, and (start, span, need: a bit for each anchor).

    Windows with a term that no document has are left out, as they cannot occur.
    """
    near = ranked.where(F.get("rare", F.lit(0))["freq"] > 0).withColumn("anchors", F.transform("rare", lambda x: x["place"]))
    pieces = near.groupBy("seq", F.floor(F.col("start") / PIECE).alias("part")).agg(F.first("all").alias("all"), F.collect_list(F.struct("start", "span", "anchors")).alias("wins"))
    pieces = pieces.withColumn("places", F.array_distinct(F.flatten(F.transform("wins", lambda w: w["anchors"]))))

    def need(w):
        return F.aggregate(w["anchors"], F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.array_position("places", p).cast("int") - 1)))

    return pieces.select(
        F.xxhash64("seq", "part").alias("piece"), "places", F.transform("places", lambda p: F.get(F.col("all"), p)).alias("terms"),
        F.transform("wins", lambda w: F.struct(w["start"].alias("start"), w["span"].alias("span"), need(w).alias("need"))).alias("wins"))


def marks(pieces: DataFrame) -> DataFrame:
    """term, piece, place, bit: the anchors."""
    zipped = F.posexplode(F.arrays_zip("places", "terms")).alias("k", "x")
    return pieces.select("piece", zipped).select(F.col("x.terms").alias("term"), "piece", F.col("x.places").alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k")).alias("bit"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index: doc_id, h, pos, term for the given distinct terms (term, freq); and for each row of docs one row of pos -1 with n_words."""
    words = clean_of(docs, "doc_id", "text").select("doc_id", text_key(F.col("text")).alias("h"), contract_words(F.col("text")).alias("w"))
    if not is_light(terms):
        places = words.select("doc_id", "h", F.posexplode("w").alias("pos", "term"))
        found = spread_join(places, terms, "term", "freq", terms.agg(F.sum("freq")).first()[0] or 0).select("doc_id", "h", "pos", "term", F.lit(None).cast("long").alias("n_words"))
        return found.unionByName(words.select("doc_id", "h", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("term"), F.size("w").cast("long").alias("n_words")))
    # a first entry that is no word carries the length
    rows = words.select("doc_id", "h", F.posexplode(F.concat(F.array(F.concat(F.lit(" "), F.size("w").cast("string"))), F.col("w"))).alias("at", "term"))
    rows = rows.join(F.broadcast(terms.select(F.col("term").alias("of_term"))), F.col("term") == F.col("of_term"), "left").where("at = 0 or of_term is not null")
    return rows.select("doc_id", "h", (F.col("at") - 1).alias("pos"), "term", F.when(F.col("at") == 0, F.trim("term").cast("long")).alias("n_words"))


def exact_places(index: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, h, found: the (span, start) where both anchors of a window meet at one shift."""
    anchors = marks(pieces)
    met = (
        index.join(light(anchors), "term")
        .groupBy("doc_id", "h", "piece", (F.col("pos") - F.col("place")).alias("shift")).agg(F.bit_or("bit").alias("met"))
    )
    wins = pieces.select("piece", "wins")
    rows = met.join(light(wins), "piece").select("doc_id", "h", "met", "shift", F.explode("wins").alias("w")).where(F.col("met").bitwiseAND(F.col("w.need")) == F.col("w.need"))
    return rows.select("doc_id", "h", F.struct(F.col("w.span").alias("span"), (F.col("shift") + F.col("w.start")).alias("start")).alias("x")).where("x.start >= 0").groupBy("doc_id", "h").agg(F.collect_set("x").alias("found"))


def near_places(index: DataFrame, passages: DataFrame, slop: int) -> DataFrame:
    """doc_id, h, near: the (passage, words, buckets) where two anchors of a passage meet within the slop.

    Shifts are put in overlapping buckets, each as wide as twice the distance that two anchors of one match can have.
    """
    wide = 2 * slop + 1
    anchors = passages.select("passage", F.posexplode("rare").alias("k", "x"), "start", "words").where("x.freq > 0").select(
        F.get(F.col("words"), F.col("x.place") - F.col("start")).alias("term"), "passage", (F.col("x.place") - F.col("start")).alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k")).alias("bit"))
    bucket = F.floor((F.col("pos") - F.col("place")) / wide).cast("int")
    met = (
        index.join(light(anchors), "term").select("doc_id", "h", "passage", "bit", F.explode(F.array(bucket, bucket - 1)).alias("bucket"))
        .groupBy("doc_id", "h", "passage", "bucket").agg(F.bit_or("bit").alias("met")).where(F.bit_count("met") >= 2)
    )
    words = passages.select("passage", "words")
    by_passage = met.groupBy("doc_id", "h", "passage").agg(F.collect_list("bucket").alias("buckets")).join(light(words), "passage")
    return by_passage.groupBy("doc_id", "h").agg(F.collect_list(F.struct("passage", "words", "buckets")).alias("near"))


def is_near(tokens: Column, candidate: Column, slop: int, least: int) -> Column:
    """Whether some shift of one of the candidate's buckets puts enough words within the slop."""
    wide = 2 * slop + 1

    def place_is_near(word, at):
        return F.array_contains(F.slice(tokens, F.greatest(at - slop, F.lit(0)) + 1, F.least(F.lit(wide), F.greatest(at + slop + 1, F.lit(0)))), word)

    def enough(shift):
        return F.size(F.filter(candidate["words"], lambda w, i: F.when(shift + i + slop < 0, False).otherwise(place_is_near(w, shift + i)))) >= least

    return F.exists(candidate["buckets"], lambda b: F.exists(F.sequence(b * wide - slop, (b + 2) * wide - 1 + slop), enough))


def covered(intervals: Column) -> Column:
    """Words in the union of (start, span)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(a, x):
        end = x["start"] + x["span"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(F.sort_array(intervals), start, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20, slop: int = 2, least: int = 11) -> DataFrame:
    """doc_id, h, n_words, n_hit, item_ids (sorted strings), starts (of exact phrase matches), near_ids (of items with proximity matches), contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words. One row for each input row.
    """
    listed = materialize(members(items), "items")
    seqs = materialize(listed.select("seq", "words").dropDuplicates(["seq"]), "seqs")
    freqs = materialize(corpus_frequencies(docs, seqs), "frequencies")
    stands = materialize(windows(seqs, every_start(), width), "windows")
    pieces = materialize(anchored_pieces(with_rarest(distinct_windows(stands), seqs, freqs, 2)), "pieces")
    near_stands = windows(seqs, side_by_side(width), width)
    passages = with_rarest(distinct_windows(near_stands), seqs, freqs, width - least + 2)
    passages = materialize(passages.select(F.xxhash64("window").alias("passage"), "words", "start", "rare"), "passages")
    near_terms = passages.select(F.explode("rare").alias("x"), "start", "words").where("x.freq > 0").select(F.get(F.col("words"), F.col("x.place") - F.col("start")).alias("term"))
    terms = materialize(pieces.select(F.explode("terms").alias("term")).unionByName(near_terms).distinct().join(freqs, "term"), "terms")
    index = materialize(postings(docs, terms), "postings")
    places = index.where("pos >= 0")
    same = ["doc_id", "h"]
    found = materialize(exact_places(places, pieces), "places")
    near = materialize(near_places(places, passages, slop), "near")
    n_places = (found.agg(F.sum(F.size("found"))).first()[0] or 0) + 16 * (near.agg(F.sum(F.size("near"))).first()[0] or 0)
    both = found.withColumn("near", F.lit(None).cast(near.schema["near"].dataType)).unionByName(near.withColumn("found", F.lit(None).cast(found.schema["found"].dataType)))
    both = both.groupBy(F.col("doc_id").alias("of_doc"), F.col("h").alias("of_h")).agg(F.max_by("found", F.size("found")).alias("found"), F.max_by("near", F.size("near")).alias("near"))
    both = materialize(both, "candidates")
    n = both.count()
    texts = clean_of(docs, "doc_id", "text").withColumn("h", text_key(F.col("text")))
    met = meet(texts, both, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("h") == F.col("of_h")), "inner", n if n_places <= BROADCAST_PLACES else 1 << 62, F.xxhash64("doc_id", "h"), F.xxhash64("of_doc", "of_h"), 1 << 61)

    def compared(tokens):
        stand = F.transform(F.coalesce("found", F.expr("cast(array() as array<struct<span:int,start:int>>)")), lambda x: F.struct(x["start"].alias("start"), x["span"].alias("span"), F.md5(F.array_join(F.slice(tokens, x["start"] + 1, x["span"]), " ")).alias("window")))
        close = F.transform(F.filter(F.coalesce("near", F.array().cast(near.schema["near"].dataType)), lambda c: is_near(tokens, c, slop, least)), lambda c: c["passage"])
        return F.struct(stand.alias("stand"), close.alias("close"))

    met = materialize(met.select(*same, let(contract_words(F.col("text")), compared).alias("c")).select(*same, "c.*"), "compared")
    known = stands.select("window").distinct()
    hits = met.select(*same, F.explode("stand").alias("x")).select(*same, "x.*").join(light(known), "window")
    exact = hits.groupBy(*same).agg(F.collect_set(F.struct("start", "span")).alias("spans"))
    close = met.select(*same, F.explode("close").alias("window"), F.lit(True).alias("close")).withColumn("window", F.col("window").cast("string"))
    told = hits.select(*same, "window", F.lit(False).alias("close")).unionByName(close).distinct()
    standing = materialize(stands.select("window", "seq", F.lit(False).alias("close")).unionByName(near_stands.select(F.xxhash64("window").cast("string").alias("window"), "seq", F.lit(True).alias("close"))).distinct(), "standing")
    names = materialize(listed.select("seq", "item_id").distinct(), "names")
    told = told.join(light(standing), ["window", "close"]).select(*same, "seq", "close").distinct().join(light(names), "seq")
    told = told.groupBy(F.col("doc_id").alias("at_doc"), F.col("h").alias("at_h")).agg(*[F.sort_array(F.collect_set(F.when(of, F.col("item_id")))).alias(n) for n, of in (("item_ids", ~F.col("close")), ("near_ids", F.col("close")))])
    exact = exact.select(F.col("doc_id").alias("of_doc"), F.col("h").alias("of_h"), covered(F.col("spans")).alias("n_hit"), F.sort_array(F.array_distinct(F.transform("spans", lambda x: x["start"]))).alias("starts"))
    rows = index.where("pos = -1").select(*same, "n_words")
    rows = rows.join(exact, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("h") == F.col("of_h")), "left").join(told, F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("h") == F.col("at_h")), "left")
    none = F.expr("cast(array() as array<string>)")
    rows = rows.select(*same, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("starts", F.expr("cast(array() as array<int>)")).alias("starts"), F.coalesce("near_ids", none).alias("near_ids"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns of the op2 query, and n_near: items with proximity matches."""
    return decontaminate(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", F.size("near_ids").cast("long").alias("n_near"))
