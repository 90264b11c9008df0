"""Text operators over documents (captions), pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import rounded
from ..operators.keyphrases import STOPWORDS, keyphrases
from ..operators.matching import tfidf
from ..operators.ranges import dealt
from ..operators.similarity import nearest
from ..operators.vectors import text_grams, vocabulary
from .fixture import table
from .catalog import query

# Demonstration lists over the fixture's languages; a deployment passes its own.
TOPICS = {"T01": ["that", "the"], "T02": ["eau", "que "], "T03": ["schaft", "keit"], "T04": ["ción", "mente"], "T05": ["Zzz"], "T06": ["*", "|"]}
SLANG = ["!!", "ation", "eux"]
GROUPS = {"english": ["tion ", "the "], "french": ["eau", "oir"], "german": ["ung ", "sch"], "spanish": ["ción", "rr"]}
DICTIONARY = {"is": "be", "de": "of", "le": "the", "the": "de", "der": "the"}


def docs(spark, sf):
    return dealt(table(spark, sf, "documents")).select(F.col("doc_id").alias("record_id"), F.col("text").alias("caption"), F.col("source").alias("page_name"), "lang")


_D = "d AS (SELECT doc_id AS record_id, text AS caption, source AS page_name, lang FROM documents)"
_WORDS = r"list_filter(regexp_split_to_array(caption, '\s+'), lambda x: x <> '')"


def _any(words, text="lower(caption)"):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _hits(pairs):
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in pairs) + "], lambda x: x IS NOT NULL)"


_TOPICS = _hits([(t, _any(k)) for t, k in TOPICS.items()])
_GROUPS = _hits([(g, _any(k)) for g, k in GROUPS.items()])
_SLANG = _hits([(t, f"contains(lower(caption), lower('{t}'))") for t in SLANG])


@query(rf"WITH {_D} SELECT record_id, md5(regexp_replace(lower(caption), '\s+', '', 'g')) AS key FROM d")
def tx1_match_key(spark, sf):
    return docs(spark, sf).select("record_id", F.md5(T.match_key("caption")).alias("key"))


@query(f"""WITH {_D}, w AS (SELECT record_id, len({_WORDS})::INT AS words FROM d)
SELECT *, CASE WHEN words <= 5 THEN 'Very Short (≤5w)' WHEN words <= 15 THEN 'Short (6-15w)' WHEN words <= 50 THEN 'Medium (16-50w)' ELSE 'Long (>50w)' END AS bucket,
CASE WHEN words < 10 THEN 'short' WHEN words <= 50 THEN 'medium' ELSE 'long' END AS class FROM w""")
def tx2_tx4_lengths(spark, sf):
    w = docs(spark, sf).select("record_id", T.word_count("caption").alias("words"))
    return w.select("*", T.length_bucket(F.col("words")).alias("bucket"), T.length_class(F.col("words")).alias("class"))


@query(f"WITH {_D} SELECT record_id, array_to_string({_TOPICS}, ',') AS topics, array_to_string({_GROUPS}, ',') AS groups, array_to_string({_SLANG}, ',') AS slang, len({_SLANG})::INT AS n_slang FROM d")
def tx5_tx9_keywords(spark, sf):
    slang = T.terms_in("caption", SLANG)
    return docs(spark, sf).select("record_id", F.array_join(T.topics_in("caption", TOPICS), ",").alias("topics"), F.array_join(T.groups_in("caption", GROUPS), ",").alias("groups"), F.array_join(slang, ",").alias("slang"), F.size(slang).alias("n_slang"))


@query(f"WITH {_D}, m AS (SELECT record_id, list_slice({_hits([(k, f'contains(lower(caption), {chr(39)}{k}{chr(39)})') for k in ['tion', 'eau', 'ung', 'ción', 'ent']])}, 1, 3) AS f FROM d) SELECT record_id, CASE WHEN len(f) = 0 THEN 'none' ELSE 'matched: ' || array_to_string(f, ', ') END AS reason FROM m")
def tx7_matched_keywords(spark, sf):
    return docs(spark, sf).select("record_id", T.matched_reason("caption", ["tion", "eau", "ung", "ción", "ent"]).alias("reason"))


@query(f"""WITH {_D}, w AS (SELECT record_id, len({_WORDS}) AS wc, len({_SLANG}) AS s, len({_GROUPS}) AS g FROM d)
SELECT record_id, CASE WHEN wc < 10 THEN 'caption too short' WHEN s > 0 THEN 'slang/metaphor' WHEN g >= 2 THEN 'multi-topic or keyword boundary ambiguity' WHEN wc > 50 THEN 'long/noisy caption' ELSE 'keyword overfitting or label boundary ambiguity' END AS reason FROM w""")
def tx10_reason(spark, sf):
    d = docs(spark, sf).select("record_id", T.word_count("caption").alias("w"), T.terms_in("caption", SLANG).alias("s"), T.groups_in("caption", GROUPS).alias("g"))
    return d.select("record_id", T.error_reason(F.col("w"), F.col("s"), F.col("g")).alias("reason"))


_TOK = r"regexp_extract_all(caption, '[0-9A-Za-zÀ-ỹ]+|[^\sA-Za-zÀ-ỹ0-9]+')"


@query(f"WITH {_D} SELECT record_id, len({_TOK})::INT AS n, md5(array_to_string({_TOK}, ' ')) AS tokens FROM d")
def tx11_tokens(spark, sf):
    return docs(spark, sf).select("record_id", T.tokens("caption").alias("t")).select("record_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


_KEYS, _VALUES = [*DICTIONARY], [*DICTIONARY.values()]
# A walk over the characters: a letter is a capital exactly if no letter stands before it.
_CASED = "lower(substr(x, {i}, 1)) <> upper(substr(x, {i}, 1))"
_TITLE = f"len(list_filter(range(1, length(x) + 1), lambda i: {_CASED.format(i='i')} AND (substr(x, i, 1) = upper(substr(x, i, 1))) = (i > 1 AND {_CASED.format(i='i - 1')}))) = 0"
_CAP = f"({_TITLE} OR x = upper(x)) AND lower(x) <> upper(x) AND lower(x) NOT IN ('ko', 'đc', 'k', 'h', 't', 'mk')"
_HIT = f"map_extract(map({_KEYS}, {_VALUES}), lower(x))[1]"
_NEW = f"CASE WHEN {_HIT} IS NOT NULL AND NOT ({_CAP}) THEN {_HIT} END"


@query(rf"""WITH {_D}, t AS (SELECT record_id, {_TOK} AS t FROM d)
SELECT record_id, md5(regexp_replace(array_to_string(list_transform(t, lambda x: coalesce({_NEW}, x)), ' '), '\s+([.,!?;:])', '\1', 'g')) AS text, len(list_filter(t, lambda x: {_NEW} IS NOT NULL))::INT AS n FROM t""")
def tx12_tx14_normalise(spark, sf):
    m = F.create_map(*[F.lit(x) for p in DICTIONARY.items() for x in p])
    return docs(spark, sf).select("record_id", T.normalised("caption", m).alias("x")).select("record_id", F.md5("x.text").alias("text"), F.col("x.count").alias("n"))


@query(f"WITH {_D}, t AS (SELECT unnest({_TOK}) AS token FROM d) SELECT token, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, token LIMIT 15")
def a32_top_tokens(spark, sf):
    return docs(spark, sf).select(F.explode(T.tokens("caption")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(15)


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_NG = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n} - 1], ' '))"


@query(rf"""WITH {_D}, w AS (SELECT record_id, list_filter(regexp_extract_all(lower(caption), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) AS w FROM d WHERE length(caption) > 3),
g AS (SELECT record_id, unnest(list_concat({_NG.format(n=2)}, {_NG.format(n=3)})) AS phrase FROM w),
c AS (SELECT phrase, count(*) AS n, count(DISTINCT record_id) AS df FROM g GROUP BY 1)
SELECT phrase, n, df FROM c WHERE df >= 2 AND df <= 0.9 * (SELECT count(*) FROM w) ORDER BY n DESC, phrase LIMIT 20""")
def tx19_keyphrases(spark, sf):
    return keyphrases(docs(spark, sf), "caption", 20)


@query(rf"""WITH b AS (SELECT item_id, {_WORDS.replace('caption', 'lower(text)')} AS w FROM benchmark), t AS (SELECT item_id, unnest(w) AS term FROM b), f AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL),
i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM b)) / (1.0 + count(*))) + 1 AS idf FROM f GROUP BY 1), r AS (SELECT item_id, f.term, tf * idf AS w FROM f JOIN i ON f.term = i.term), n AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1)
SELECT r.item_id, r.term, round(w / norm, 6) AS weight FROM r JOIN n ON r.item_id = n.item_id""")
def tx20_tfidf(spark, sf):
    b = table(spark, sf, "benchmark")
    weights, _ = tfidf(b, "item_id", F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda x: x != ""))
    return weights.select("item_id", F.col("gram").alias("term"), rounded("weight").alias("weight"))


_WB = "list_transform(range(1, length(p) - {n} + 2), lambda i: substr(p, i, {n}))"


@query(rf"""WITH b AS (SELECT item_id, {_WORDS.replace('caption', 'lower(text)')} AS w FROM benchmark), p AS (SELECT item_id, ' ' || unnest(w) || ' ' AS p FROM b),
t AS (SELECT item_id, unnest(list_concat(list_concat({_WB.format(n=3)}, {_WB.format(n=4)}), {_WB.format(n=5)})) AS term FROM p), f AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL),
c AS (SELECT term, count(*) AS df, sum(tf) AS total FROM f GROUP BY 1), i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM b)) / (1.0 + df)) + 1 AS idf FROM c WHERE df >= 2 AND df <= 0.95 * (SELECT count(*) FROM b) ORDER BY total DESC, term LIMIT 1000),
r AS (SELECT item_id, f.term, (1 + ln(tf)) * idf AS w FROM f JOIN i ON f.term = i.term), n AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1)
SELECT r.item_id, r.term, round(w / norm, 6) AS weight FROM r JOIN n ON r.item_id = n.item_id""")
def tx20_features(spark, sf):
    """Character n-grams inside words, in two items or more and in 95 % or fewer, the 1,000 most frequent, with logarithmic counts."""
    b = table(spark, sf, "benchmark")
    grams = text_grams("text", "char_wb", (3, 5))
    fitted = vocabulary(b, "item_id", grams, 2, 0.95, 1000).select("gram", "idf")
    weights, _ = tfidf(b, "item_id", grams, fitted, sublinear=True)
    return weights.select("item_id", F.col("gram").alias("term"), rounded("weight").alias("weight"))


@query("""WITH p AS (SELECT q.vec_id AS query, e.vec_id AS vec, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, vec, round(c, 5) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, vec) = 1""")
def tx21_cosine(spark, sf):
    """The most similar other vector of every twentieth, among all."""
    e = table(spark, sf, "embeddings")
    return nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding").select("query", "vec", F.round("cosine", 5).alias("cosine"))


@query(rf"SELECT page_id, regexp_replace(regexp_replace(url, '[^\p{{L}}\p{{N}}]', '_', 'g'), '^_+|_+$', '', 'g') AS slug, string_split(string_split(url, '?')[1], '/')[-1] AS tail FROM pages")
def tx22_tx25_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.slug("url").alias("slug"), T.url_id("url").alias("tail"))


@query(r"SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, try_cast(nullif(regexp_extract(html, 'content=\D*(\d+)', 1), '') AS BIGINT) AS number FROM pages")
def tx24_first_match(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.first_match("html", ["<title>([^<]*)</title>"]).alias("title"), T.first_match("html", [r"content=\D*(\d+)"]).try_cast("bigint").alias("number"))


@query(rf"WITH {_D} SELECT record_id, regexp_replace(left(caption, 40), '^\s+|\s+$', '', 'g') || '...' AS short FROM d WHERE regexp_matches(caption, '(?i)th(e|at) .*ed')")
def f11_tx17_tx23_search(spark, sf):
    return docs(spark, sf).where(F.col("caption").rlike(r"(?i)th(e|at) .*ed")).select("record_id", F.concat(T.stripped(F.substring("caption", 1, 40)), F.lit("...")).alias("short"))


@query(rf"WITH {_D}, t AS (SELECT lang, trim(caption) = '' OR caption IS NULL AS blank, len({_WORDS}) AS n FROM d) SELECT lang, count(*) FILTER (WHERE blank) AS n_blank, count(*) FILTER (WHERE NOT blank) AS n_kept, round(avg(CASE WHEN n > 0 THEN 100.0 / n END), 6) AS density FROM t GROUP BY 1")
def f16_a20_blank_rows(spark, sf):
    d = docs(spark, sf).select("lang", (F.trim(F.coalesce("caption", F.lit(""))) == "").alias("blank"), T.word_count("caption").alias("n"))
    return d.groupBy("lang").agg(F.count_if("blank").alias("n_blank"), F.count_if(~F.col("blank")).alias("n_kept"), rounded(F.avg(100.0 / F.nullif(F.col("n"), F.lit(0)))).alias("density"))


@query(r"SELECT role, count(*) AS n, sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS numbers, sum((length(text) - length(replace(text, 'th', ''))) // 2)::BIGINT AS marks FROM conversations GROUP BY 1")
def s19_log_scan(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.regexp_count("text", F.lit("[0-9]+"))).cast("bigint").alias("numbers"), F.sum(F.regexp_count("text", F.lit("th"))).cast("bigint").alias("marks"))


@query(r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, 'th[ae]') THEN trim(regexp_extract(text, '(?s)^.*(?:th[ae])([^\n]*)', 1)) END AS tail FROM conversations")
def s19_log_tails(spark, sf):
    """What each message says after the last mark in it."""
    return table(spark, sf, "conversations").select("conv_id", "turn", T.last_tail("text", "th[ae]").alias("tail"))
