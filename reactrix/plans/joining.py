"""Joins, unions and deduplication of labelled and crawled text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.text import match_key
from ..operators import matching
from ..operators.ranking import distinct_first
from ..streaming.incremental import post_key
from .captions import docs
from .fixture import POSTS, posts, table
from .catalog import query

_K = r"k AS (SELECT doc_id, source, lang, regexp_replace(lower(coalesce(text, '')), '\s+', '', 'g') AS key FROM documents)"


def both_sides(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("labelled_id"), F.col("text").alias("content")), d.select(F.col("doc_id").alias("post_id"), F.col("text").alias("post_content"))


@query(f"WITH {_K}, g AS (SELECT key, min(doc_id) AS post_id, count(*) AS n_posts FROM k GROUP BY 1) SELECT doc_id AS labelled_id, post_id, n_posts FROM k JOIN g ON k.key = g.key")
def j1_exact_match(spark, sf):
    """All documents with all: each with the first of its posts and their number, so groups of copies don't multiply."""
    left, right = both_sides(spark, sf)
    return matching.exact_groups(left, right, "content", "post_content", "post_id").select("labelled_id", "post_id", F.col("n").alias("n_posts"))


@query(f"WITH {_K}, r AS (SELECT key, min(doc_id) AS post_id FROM k WHERE key <> '' GROUP BY 1) SELECT doc_id AS labelled_id, post_id FROM k JOIN r ON k.key = r.key")
def j2_exact_match_once(spark, sf):
    left, right = both_sides(spark, sf)
    return matching.exact_match_once(left, right, "content", "post_content", "post_id").select("labelled_id", "post_id")


_FUZZY = r"""WITH b AS (SELECT item_id, regexp_replace(lower(text), '\s+', '', 'g') AS key FROM benchmark),
l AS (SELECT item_id AS left_id, key FROM (SELECT item_id, left(key, length(key) - (item_id % 9)::INT) AS key FROM b) WHERE key <> ''),
r AS (SELECT min(item_id) AS r, key FROM b WHERE key <> '' GROUP BY key),
lg AS (SELECT key, unnest(list_concat(list_concat(g2, g3), g4)) AS g FROM (SELECT DISTINCT key, list_transform(range(1, length(p)), lambda i: substr(p, i, 2)) AS g2, list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)) AS g3, list_transform(range(1, length(p) - 2), lambda i: substr(p, i, 4)) AS g4 FROM (SELECT key, ' ' || key || ' ' AS p FROM l))),
rg AS (SELECT key, unnest(list_concat(list_concat(g2, g3), g4)) AS g FROM (SELECT key, list_transform(range(1, length(p)), lambda i: substr(p, i, 2)) AS g2, list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)) AS g3, list_transform(range(1, length(p) - 2), lambda i: substr(p, i, 4)) AS g4 FROM (SELECT key, ' ' || key || ' ' AS p FROM r))),
rt AS (SELECT key, g, count(*) AS tf FROM rg GROUP BY ALL), idf AS (SELECT g, ln((1.0 + (SELECT count(*) FROM r)) / (1.0 + count(*))) + 1 AS idf FROM rt GROUP BY g),
rw AS (SELECT rt.key, rt.g, tf * idf AS w FROM rt JOIN idf ON rt.g = idf.g), rn AS (SELECT key, sqrt(sum(w * w)) AS n FROM rw GROUP BY 1),
lt AS (SELECT key, g, count(*) AS tf FROM lg GROUP BY ALL), lw AS (SELECT lt.key, lt.g, tf * idf AS w FROM lt JOIN idf ON lt.g = idf.g), ln_ AS (SELECT key, sqrt(sum(w * w)) AS n FROM lw GROUP BY 1),
s AS (SELECT lw.key AS lk, rw.key AS rk, sum(lw.w * rw.w) / any_value(ln_.n) / any_value(rn.n) AS sim FROM lw JOIN rw ON lw.g = rw.g JOIN ln_ ON ln_.key = lw.key JOIN rn ON rn.key = rw.key GROUP BY 1, 2),
best AS (SELECT lk, r.r AS match_item_id, sim FROM s JOIN r ON r.key = s.rk WHERE sim > 0.85 QUALIFY row_number() OVER (PARTITION BY lk ORDER BY round(sim, 9) DESC, r.r) = 1)
SELECT left_id, match_item_id, round(sim, 6) AS similarity FROM l JOIN best ON l.key = best.lk"""


@query(_FUZZY)
def j3_fuzzy_match(spark, sf):
    """Benchmark items cut short by up to eight characters, against the whole ones."""
    b = table(spark, sf, "benchmark")
    key = match_key("text")
    left = b.select(F.col("item_id").alias("left_id"), F.substring(key, F.lit(1), (F.length(key) - F.col("item_id") % 9).cast("int")).alias("content"))
    return matching.fuzzy_match(left, b, "left_id", "item_id", "content", "text").select("left_id", "match_item_id", rounded("similarity").alias("similarity"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4_u3_anti_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query(f"WITH {_K}, b AS (SELECT key FROM k WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT kind, count(*) AS n FROM (SELECT 'exact' AS kind, a.doc_id FROM k a SEMI JOIN b ON a.key = b.key UNION ALL SELECT 'rest', a.doc_id FROM k a ANTI JOIN b ON a.key = b.key) GROUP BY 1")
def j5_u1_union(spark, sf):
    """Documents whose text a labelled document has, and the others."""
    d = docs(spark, sf).select("record_id", F.md5(match_key("caption")).alias("key"))
    labelled = d.join(table(spark, sf, "labels").select(F.col("doc_id").alias("record_id")), "record_id", "left_semi").select("key")
    exact = d.join(labelled, "key", "left_semi").select(F.lit("exact").alias("kind"), "record_id")
    rest = d.join(labelled, "key", "left_anti").select("record_id", F.lit("rest").alias("kind"))
    return exact.unionByName(rest).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE source WHEN 'src0' THEN 'newspaper' WHEN 'src1' THEN 'entertainment' ELSE 'Other' END AS source_type FROM documents")
def j7_source_type(spark, sf):
    kinds = spark.range(1).select(F.explode(F.create_map(F.lit("src0"), F.lit("newspaper"), F.lit("src1"), F.lit("entertainment"))).alias("source", "kind"))
    return table(spark, sf, "documents").join(F.broadcast(kinds), "source", "left").select("doc_id", F.coalesce("kind", F.lit("Other")).alias("source_type"))


@query("SELECT count(*) AS n_both FROM (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def j10_u2_overlap(spark, sf):
    o = table(spark, sf, "orders")
    f, p = (o.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("c_custkey")) for x in "FO")
    return table(spark, sf, "customer").select("c_custkey").join(f, "c_custkey", "left_semi").intersect(p).agg(F.count("*").alias("n_both"))


@query("SELECT r_name AS region, n_name AS nation, coalesce(count(c_custkey), 0) AS n FROM region CROSS JOIN (SELECT DISTINCT n_name, n_nationkey, n_regionkey FROM nation) LEFT JOIN customer ON c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY ALL")
def j11_axis_complete(spark, sf):
    """Region x nation grid with zero cells; both axes are fixed small label sets."""
    nation = table(spark, sf, "nation")
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    grid = table(spark, sf, "region").crossJoin(F.broadcast(nation)).join(counts, "n_nationkey", "left")
    return grid.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.when(F.col("n_regionkey") == F.col("r_regionkey"), F.coalesce("k", F.lit(0))).otherwise(F.lit(0)).alias("n"))


@query("SELECT o_orderpriority AS label, count(*) AS n, count(*) FILTER (WHERE k IS NULL) AS n_dropped, round(avg((k IS NULL)::INT), 6) AS drop_rate FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON o_orderkey = k GROUP BY 1")
def a38_drop_rate(spark, sf):
    keys = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "label")
    return matching.drop_rate(orders, keys, "o_orderkey", "label").withColumn("drop_rate", rounded("drop_rate"))


@query(f"WITH {_K} SELECT min(doc_id) AS doc_id, count(*) AS copies FROM k GROUP BY key HAVING count(*) > 1")
def w8_x6_duplicates(spark, sf):
    d = docs(spark, sf).select("record_id", match_key("caption").alias("key"))
    return d.groupBy("key").agg(F.min("record_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").drop("key")


@query("WITH k AS (SELECT doc_id, coalesce(CASE WHEN source = 'src0' THEN 'at ' || (doc_id // 100) END, sha256(left(text, 50))) AS key FROM documents) SELECT doc_id FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1")
def x6_dedup_key(spark, sf):
    """Posts are the same by their address; without one, by their first 50 characters."""
    url = F.when(F.col("page_name") == "src0", F.concat(F.lit("at "), F.floor(F.col("record_id") / 100))).otherwise(F.lit(""))
    d = docs(spark, sf).select(F.col("record_id").alias("doc_id"), url.alias("post_url"), F.col("caption").alias("post_content")).select("doc_id", post_key().alias("key"))
    return distinct_first(d, ["key"], "doc_id").select("doc_id")


_UNIT = "SELECT page_name, count(*) AS n FROM posts GROUP BY 1"


@query(f"WITH {POSTS}, f AS ({_UNIT}) SELECT coalesce(t.id, s.id) AS id, coalesce(t.name, s.name) AS name FROM (SELECT page_name AS id, page_name || '!' AS name FROM f WHERE n > 590) t FULL JOIN (SELECT page_name AS id, 'fallback' AS name FROM f) s ON t.id = s.id")
def s7_taxonomy_fallback(spark, sf):
    f = posts(spark, sf).groupBy(F.col("page_name").alias("id")).agg(F.count("*").alias("n"))
    loaded = f.where("n > 590").select("id", F.concat("id", F.lit("!")).alias("name"))
    return loaded.join(f.select("id", F.lit("fallback").alias("fallback")), "id", "full_outer").select("id", F.coalesce("name", "fallback").alias("name"))
