"""Filters, derived metrics, aggregates and rankings over enriched posts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.numbers import half_even, ratio, rounded
from ..functions.text import preview, topic_code, topic_name
from ..operators.ranges import quantiles, stored
from ..operators.ranking import best_in_group, rank_pct, top_k
from .fixture import ENRICHED, POSTS, enriched, posts, reaction_posts, table
from .catalog import query

R = lambda *names: [rounded(n).alias(n) for n in names]


def r6(*names):
    return ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in names)


INDICES = ["intensity", "valence", "polarity_sign", "polarity_laplace"]
RATIOS = [f"{x}_ratio" for x in M.REACTIONS if x != "like"]
SUBS = ["approval", "outrage", "amusement", "empathy"]
FOLLOWED = ["reactions_per_follower", "rel_spread", "rel_discussion", "rel_like", "engagement_per_follower"]
TOPIC, PAGE = "topic_label_final", "page_name"


@query(f"WITH {ENRICHED} SELECT record_id, pos_react, neg_react, {r6(*INDICES)} FROM e")
def m1_m5_indices(spark, sf):
    return enriched(spark, sf).select("record_id", "pos_react", "neg_react", *R(*INDICES))


@query(f"WITH {ENRICHED} SELECT record_id, {r6(*RATIOS, *SUBS)} FROM e")
def m6_m7_ratios(spark, sf):
    return enriched(spark, sf).select("record_id", *R(*RATIOS, *SUBS))


@query(f"WITH {ENRICHED} SELECT record_id, engagement_total, {r6(*FOLLOWED)} FROM e")
def m8_m9_m12_followers(spark, sf):
    return enriched(spark, sf).select("record_id", "engagement_total", *R(*FOLLOWED))


@query(f"WITH {ENRICHED} SELECT record_id, {r6('controversy', 'sarcasm')} FROM e")
def m10_m11_controversy(spark, sf):
    return enriched(spark, sf).select("record_id", *R("controversy", "sarcasm"))


@query(f"WITH {ENRICHED} SELECT record_id, round_even(engagement_per_follower * 100000, 1) AS per_100k FROM e")
def m13_per_100k(spark, sf):
    return enriched(spark, sf).select("record_id", M.per_100k(F.col("engagement_total")).alias("per_100k"))


@query(f"""WITH {ENRICHED}, m AS (SELECT avg(polarity_sign) AS p FROM e)
SELECT round(p, 6) AS polarity, CASE WHEN p > 0.05 THEN 'positive' WHEN p < -0.05 THEN 'negative' ELSE 'neutral' END AS band FROM m""")
def m14_polarity_band(spark, sf):
    p = F.col("p")
    return enriched(spark, sf).agg(F.avg("polarity_sign").alias("p")).select(rounded("p").alias("polarity"), F.when(p > 0.05, "positive").when(p < -0.05, "negative").otherwise("neutral").alias("band"))


@query(f"""WITH {ENRICHED}, a AS (SELECT topic_label_final AS topic, avg(controversy) AS c, avg(sarcasm) * 100 AS s FROM r GROUP BY 1)
SELECT round(max(c), 6) AS worst_controversy, round(max(s), 6) AS worst_sarcasm, max(c) >= 0.4 OR max(s) >= 30 AS high_risk FROM a""")
def m17_high_risk(spark, sf):
    a = reaction_posts(spark, sf).groupBy(TOPIC).agg(F.avg("controversy").alias("c"), (F.avg("sarcasm") * 100).alias("s"))
    return a.agg(F.max("c").alias("c"), F.max("s").alias("s")).select(rounded("c").alias("worst_controversy"), rounded("s").alias("worst_sarcasm"), ((F.col("c") >= 0.4) | (F.col("s") >= 30)).alias("high_risk"))


# --- filters ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL AND text <> ''")
def f1_f2_labelled(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id")
    return d.join(table(spark, sf, "labels").where(F.col("quality").isNotNull()), "doc_id").select("doc_id", "quality")


@query(f"""WITH {ENRICHED} SELECT record_id, topic_label_final, total_reactions FROM e
WHERE usable_for_engagement_analysis_strict = 1 AND (parsed_date IS NULL OR parsed_date BETWEEN DATE '1994-01-01' AND DATE '1995-06-30') AND topic_label_final IN ('1-URGENT', '2-HIGH') AND total_reactions >= 100""")
def f3_f6_filter_chain(spark, sf):
    p = posts(spark, sf).where("usable_for_engagement_analysis_strict = 1").where(F.col("parsed_date").isNull() | F.col("parsed_date").between("1994-01-01", "1995-06-30"))
    return p.where(F.col(TOPIC).isin("1-URGENT", "2-HIGH") & (F.col("total_reactions") >= 100)).select("record_id", TOPIC, "total_reactions")


@query(f"WITH {ENRICHED} SELECT count(*) AS n, sum(total_reactions)::BIGINT AS reactions FROM r")
def f8_reaction_eligible(spark, sf):
    return reaction_posts(spark, sf).agg(F.count("*").alias("n"), F.sum("total_reactions").alias("reactions"))


@query(f"WITH {ENRICHED} SELECT record_id, topic_label_final FROM e WHERE substr(topic_label_final, 1, 3) IN ('1-U', '3-M')")
def f9_serious_topics(spark, sf):
    return posts(spark, sf).where(F.substring(TOPIC, 1, 3).isin("1-U", "3-M")).select("record_id", TOPIC)


@query(f"WITH {ENRICHED} SELECT record_id, round(sarcasm, 6) AS sarcasm FROM e WHERE sarcasm > 0.35 AND total_reactions >= 10 ORDER BY e.sarcasm DESC, record_id LIMIT 50")
def f10_sarcasm_alerts(spark, sf):
    return top_k(enriched(spark, sf).where("sarcasm > 0.35 and total_reactions >= 10"), "sarcasm", 50, "record_id").select("record_id", *R("sarcasm"))


@query(f"WITH {ENRICHED}, a AS (SELECT avg(controversy) FILTER (WHERE topic_label_final LIKE '1-U%') AS t, avg(controversy) AS c FROM e) SELECT round(coalesce(t, c), 6) AS expected FROM a")
def f12_prefix_fallback(spark, sf):
    return enriched(spark, sf).agg(F.coalesce(F.avg(F.when(F.col(TOPIC).startswith("1-U"), F.col("controversy"))), F.avg("controversy")).alias("x")).select(rounded("x").alias("expected"))


@query(f"WITH {POSTS} SELECT record_id, page_name, total_reactions FROM posts ORDER BY total_reactions DESC, record_id LIMIT 20")
def f13_k1_preview(spark, sf):
    return top_k(posts(spark, sf), "total_reactions", 20, "record_id").select("record_id", PAGE, "total_reactions")


@query(f"WITH {ENRICHED} SELECT page_name, topic_label_final, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 15")
def f14_minimum_support(spark, sf):
    return posts(spark, sf).groupBy(PAGE, TOPIC).agg(F.count("*").alias("n")).where("n >= 15")


@query(f"WITH {POSTS} SELECT record_id AS id, topic_label_final AS topic, 'Other' AS source_type, 0::BIGINT AS sorry_count FROM posts")
def f15_f17_rename_defaults(spark, sf):
    p = posts(spark, sf).withColumnsRenamed({"record_id": "id", TOPIC: "topic"})
    return p.withColumns({c: v for c, v in (("source_type", F.lit("Other")), ("sorry_count", F.lit(0).cast("bigint"))) if c not in p.columns}).select("id", "topic", "source_type", "sorry_count")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query(f"WITH {POSTS} SELECT topic_label_final AS topic, count(record_id) AS n, count(DISTINCT page_name) AS n_pages FROM posts GROUP BY 1")
def a1_topic_counts(spark, sf):
    return posts(spark, sf).groupBy(F.col(TOPIC).alias("topic")).agg(F.count("record_id").alias("n"), F.count_distinct(PAGE).alias("n_pages"))


@query(f"WITH {POSTS} SELECT page_name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM posts GROUP BY 1")
def a2_value_counts(spark, sf):
    c = stored(posts(spark, sf).groupBy(PAGE).agg(F.count("*").alias("n")), "counts")
    total = c.agg(F.sum("n")).first()[0] or 0
    return c.select(PAGE, "n", rounded(F.col("n") * 100.0 / F.lit(total)).alias("share"))


MEANS = ["controversy", "sarcasm", *SUBS]


@query(f"WITH {ENRICHED} SELECT topic_label_final AS topic, count(*) AS n, round(avg(engagement_total), 6) AS engagement, {', '.join(f'round(avg({m}), 6) AS {m}' for m in MEANS)} FROM r GROUP BY 1")
def a3_topic_means(spark, sf):
    return reaction_posts(spark, sf).groupBy(F.col(TOPIC).alias("topic")).agg(F.count("*").alias("n"), rounded(F.avg("engagement_total")).alias("engagement"), *[rounded(F.avg(m)).alias(m) for m in MEANS])


@query(f"WITH {ENRICHED} SELECT topic_label_final AS topic, round(avg(polarity_laplace), 6) AS polarity, sum(engagement_total)::BIGINT AS engagement, count(*) AS n FROM e GROUP BY 1")
def a4_opinion_map(spark, sf):
    return enriched(spark, sf).groupBy(F.col(TOPIC).alias("topic")).agg(rounded(F.avg("polarity_laplace")).alias("polarity"), F.sum("engagement_total").alias("engagement"), F.count("*").alias("n"))


@query(f"""WITH {ENRICHED}, a AS (SELECT topic_label_final AS topic, round(avg(controversy), 9) AS c FROM r GROUP BY 1)
SELECT (SELECT topic FROM a ORDER BY c DESC, topic LIMIT 1) AS worst, (SELECT topic FROM a ORDER BY c, topic LIMIT 1) AS best""")
def a5_best_worst_topic(spark, sf):
    a = reaction_posts(spark, sf).groupBy(F.col(TOPIC).alias("topic")).agg(F.round(F.avg("controversy"), 9).alias("c"))
    # the least topic wins ties on either side
    low = F.min(F.struct("c", "topic"))["topic"]
    high = F.min(F.struct(-F.col("c"), "topic"))["topic"]
    return a.agg(high.alias("worst"), low.alias("best"))


@query(f"WITH {POSTS}, c AS (SELECT topic_label_final AS topic, page_name, count(*) AS n FROM posts GROUP BY ALL) SELECT topic, page_name, n FROM c QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, page_name) = 1")
def a6_top_page(spark, sf):
    c = posts(spark, sf).groupBy(F.col(TOPIC).alias("topic"), PAGE).agg(F.count("*").alias("n"))
    return best_in_group(c, ["topic"], F.col("n").desc(), F.col(PAGE))


@query(f"""WITH {POSTS}, c AS (SELECT topic_label_final AS topic, page_name, count(*) AS n FROM posts GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY topic)::BIGINT AS total, count(*) OVER (PARTITION BY topic) AS n_pages, row_number() OVER (PARTITION BY topic ORDER BY n DESC, page_name) AS k FROM c)
SELECT topic, page_name AS top_page, n AS top_n, total, n_pages, round_even(100.0 * n / total, 1) AS share, 100.0 * n / total > 50 OR n_pages <= 2 AS biased FROM w WHERE k = 1""")
def a7_j6_topic_concentration(spark, sf):
    c = posts(spark, sf).groupBy(F.col(TOPIC).alias("topic"), PAGE).agg(F.count("*").alias("n"))
    w = Window.partitionBy("topic")
    c = c.withColumns({"total": F.sum("n").over(w), "n_pages": F.count("*").over(w)})
    share = F.col("n") * 100.0 / F.col("total")
    return best_in_group(c, ["topic"], F.col("n").desc(), F.col(PAGE)).select("topic", F.col(PAGE).alias("top_page"), F.col("n").alias("top_n"), "total", "n_pages", half_even(share, 1).alias("share"), ((share > 50) | (F.col("n_pages") <= 2)).alias("biased"))


@query(f"WITH {ENRICHED} SELECT round(quantile_cont(controversy, 0.9), 6) AS q90, round(quantile_cont(sarcasm, 0.75), 6) AS q75, round(median(total_reactions), 6) AS mid FROM e")
def a11_quantiles(spark, sf):
    long = enriched(spark, sf).select("controversy", "sarcasm", F.col("total_reactions").cast("double").alias("total_reactions")).unpivot([], ["controversy", "sarcasm", "total_reactions"], "metric", "value")
    found = quantiles(long, ["metric"], "value", q90=0.9, q75=0.75, mid=0.5)
    one = found.agg(*[F.max(F.when(F.col("metric") == m, F.col(n))).alias(n) for m, n in (("controversy", "q90"), ("sarcasm", "q75"), ("total_reactions", "mid"))])
    return one.select(*R("q90", "q75", "mid"))


@query(f"WITH {POSTS} SELECT page_name, count(*) FILTER (WHERE angry_count > 0) AS n_angry, round(100 * avg((angry_count > 0)::INT), 6) AS pct_angry FROM posts GROUP BY 1")
def a12_conditional_counts(spark, sf):
    return posts(spark, sf).groupBy(PAGE).agg(F.count_if(F.col("angry_count") > 0).alias("n_angry"), rounded(F.avg((F.col("angry_count") > 0).cast("int")) * 100).alias("pct_angry"))


_UN = " UNION ALL ".join(f"SELECT topic_label_final AS topic, '{r}' AS reaction, sum({r}_count)::BIGINT AS n FROM posts GROUP BY 1" for r in M.REACTIONS)


@query(f"WITH {POSTS} SELECT * FROM ({_UN}) WHERE n > 0")
def a13_x7_reaction_totals(spark, sf):
    wide = posts(spark, sf).groupBy(F.col(TOPIC).alias("topic")).agg(*[F.sum(f"{r}_count").alias(r) for r in M.REACTIONS])
    return wide.unpivot(["topic"], M.REACTIONS, "reaction", "n").where("n > 0")


@query(f"WITH {POSTS} SELECT round(avg((has_page_followers = 0)::INT), 6) AS no_followers, round(avg((post_created_hour IS NULL)::INT), 6) AS no_hour, round(avg((usable_for_reaction_analysis = 1)::INT), 6) AS usable FROM posts")
def a14_missing_rates(spark, sf):
    share = lambda c: rounded(F.avg(c.cast("int")))
    return posts(spark, sf).agg(share(F.col("has_page_followers") == 0).alias("no_followers"), share(F.col("post_created_hour").isNull()).alias("no_hour"), share(F.col("usable_for_reaction_analysis") == 1).alias("usable"))


@query(f"""WITH {ENRICHED}, d AS (SELECT parsed_date, topic_label_final AS topic, avg(controversy) AS c FROM r GROUP BY ALL),
t AS (SELECT topic FROM d GROUP BY 1 ORDER BY round(avg(c), 9) DESC, topic LIMIT 3) SELECT parsed_date, topic, round(c, 6) AS controversy FROM d WHERE topic IN (SELECT topic FROM t)""")
def a15_daily_trend(spark, sf):
    d = reaction_posts(spark, sf).groupBy("parsed_date", F.col(TOPIC).alias("topic")).agg(F.avg("controversy").alias("c"))
    top = d.groupBy("topic").agg(F.round(F.avg("c"), 9).alias("m")).orderBy(F.col("m").desc(), "topic").limit(3).select("topic")
    return d.join(top, "topic", "left_semi").select("parsed_date", "topic", rounded("c").alias("controversy"))


@query(f"""WITH {ENRICHED}, a AS (SELECT topic_label_final AS topic, count(*) AS volume, avg(engagement_total) AS engagement, avg(controversy) AS c FROM e GROUP BY 1),
w AS (SELECT *, median(volume) OVER () AS mv, median(engagement) OVER () AS me, min(c) OVER () AS lo, max(c) OVER () AS hi FROM a)
SELECT topic, volume, round(engagement, 6) AS engagement, round(c, 6) AS controversy, round(CASE WHEN hi > lo THEN 10 + 30 * (c - lo) / (hi - lo) ELSE 25 END, 6) AS bubble,
CASE WHEN volume >= mv AND engagement >= me THEN 'core' WHEN volume >= mv THEN 'crowded' WHEN engagement >= me THEN 'niche' ELSE 'quiet' END AS quadrant FROM w""")
def a16_m15_quadrant(spark, sf):
    a = enriched(spark, sf).groupBy(F.col(TOPIC).alias("topic")).agg(F.count("*").alias("volume"), F.avg("engagement_total").alias("e"), F.avg("controversy").alias("c"))
    all_ = Window.partitionBy()
    v, e = F.col("volume") >= F.median("volume").over(all_), F.col("e") >= F.median("e").over(all_)
    lo, hi = F.min("c").over(all_), F.max("c").over(all_)
    return a.select("topic", "volume", rounded("e").alias("engagement"), rounded("c").alias("controversy"), rounded(F.when(hi > lo, (F.col("c") - lo) / (hi - lo) * 30 + 10).otherwise(25.0)).alias("bubble"), F.when(v & e, "core").when(v, "crowded").when(e, "niche").otherwise("quiet").alias("quadrant"))


@query(f"""WITH {ENRICHED}, a AS (SELECT page_name, avg(controversy) AS c, avg(sarcasm) AS s FROM r GROUP BY 1), q AS (SELECT greatest(quantile_cont(c, 0.75), 0.4) AS qc, greatest(quantile_cont(s, 0.75), 0.2) AS qs FROM a)
SELECT page_name, CASE WHEN c >= qc AND s >= qs THEN 'both' WHEN c >= qc THEN 'controversy' WHEN s >= qs THEN 'sarcasm' ELSE 'normal' END AS anomaly FROM a, q""")
def m16_bubble_anomaly(spark, sf):
    a = stored(reaction_posts(spark, sf).groupBy(PAGE).agg(F.avg("controversy").alias("c"), F.avg("sarcasm").alias("s")), "pages")
    upper = {r.metric: r.q for r in quantiles(a.unpivot([], ["c", "s"], "metric", "value"), ["metric"], "value", q=0.75).collect()}  # two rows
    c = F.col("c") >= F.greatest(F.lit(upper.get("c")).cast("double"), F.lit(0.4))
    s = F.col("s") >= F.greatest(F.lit(upper.get("s")).cast("double"), F.lit(0.2))
    return a.select(PAGE, F.when(c & s, "both").when(c, "controversy").when(s, "sarcasm").otherwise("normal").alias("anomaly"))


@query(f"WITH {ENRICHED} SELECT count(*) AS n, sum(engagement_total)::BIGINT AS engagement, count(DISTINCT page_name) AS pages, round(avg(engagement_total), 6) AS per_post, round(count(*) / count(DISTINCT page_name), 6) AS per_page FROM e")
def a34_kpis(spark, sf):
    e = enriched(spark, sf).groupBy(PAGE).agg(F.count("*").alias("n"), F.sum("engagement_total").alias("e"))
    return e.agg(F.sum("n").alias("n"), F.sum("e").alias("engagement"), F.count("*").alias("pages")).select("n", "engagement", "pages", rounded(ratio("engagement", "n")).alias("per_post"), rounded(ratio("n", "pages")).alias("per_page"))


_TONES = ["approval", "outrage", "amusement", "empathy"]


@query(f"WITH {ENRICHED}, a AS (SELECT {', '.join(f'avg({t}) AS {t}' for t in _TONES)} FROM r), s AS (SELECT *, CASE WHEN {' + '.join(_TONES)} = 0 THEN 1e-9 ELSE {' + '.join(_TONES)} END AS total FROM a) "
       + " UNION ALL ".join(f"SELECT '{t}' AS tone, round({t} / total, 6) AS share FROM s" for t in _TONES))
def a35_tone_composition(spark, sf):
    a = reaction_posts(spark, sf).agg(*[F.avg(t).alias(t) for t in _TONES])
    total = sum((F.col(t) for t in _TONES), F.lit(0.0))
    total = F.when(total == 0, 1e-9).otherwise(total)
    return a.select(*[rounded(F.col(t) / total).alias(t) for t in _TONES]).unpivot([], _TONES, "tone", "share")


# --- ranks -----------------------------------------------------------------------------------------------------------


def _pct(v):
    return f"(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0) / count({v}) OVER () * 100"


@query(f"WITH {ENRICHED} SELECT record_id, round({_pct('total_reactions')}, 6) AS pct_reactions, round({_pct('share_count')}, 6) AS pct_shares FROM r")
def w1_percentile_ranks(spark, sf):
    r = reaction_posts(spark, sf).select("record_id", "total_reactions", "share_count")
    r = rank_pct(rank_pct(r, "total_reactions", "pct_reactions"), "share_count", "pct_shares")
    return r.select("record_id", *R("pct_reactions", "pct_shares"))


@query(f"WITH {ENRICHED}, a AS (SELECT topic_label_final AS topic, round(avg(controversy), 9) AS c FROM r GROUP BY 1) SELECT topic, round_even({_pct('c')}, 0)::INT AS pct, 'Top ' || (100 - round_even({_pct('c')}, 0)::INT) || '%' AS tag FROM a")
def w2_topic_percentiles(spark, sf):
    a = reaction_posts(spark, sf).groupBy(F.col(TOPIC).alias("topic")).agg(F.round(F.avg("controversy"), 9).alias("c"))
    return rank_pct(a, "c", "p").select("topic", half_even("p", 0).cast("int").alias("pct")).withColumn("tag", F.concat(F.lit("Top "), 100 - F.col("pct"), F.lit("%")))


@query(f"WITH {ENRICHED}, x AS (SELECT {_pct('sarcasm')} AS p FROM e) SELECT round(avg(p), 6) AS mean_percentile FROM x")
def w3_mean_percentile(spark, sf):
    return rank_pct(enriched(spark, sf).select("sarcasm"), "sarcasm", "p").agg(rounded(F.avg("p")).alias("mean_percentile"))


@query(f"""WITH {ENRICHED}, x AS (SELECT *, {_pct('engagement_total')} AS p FROM e)
SELECT record_id, engagement_total, round_even(engagement_per_follower * 100000, 1) AS per_100k, round(p, 6) AS pct FROM x ORDER BY engagement_total DESC, record_id LIMIT 10""")
def k2_virality_ledger(spark, sf):
    e = enriched(spark, sf).select("record_id", "engagement_total", "has_page_followers", "page_followers")
    return top_k(rank_pct(e, "engagement_total", "pct"), "engagement_total", 10, "record_id").select("record_id", "engagement_total", M.per_100k(F.col("engagement_total")).alias("per_100k"), *R("pct"))


@query(f"""WITH {POSTS}, n AS (SELECT record_id, topic_label_final AS topic, page_name, array_to_string(list_transform(string_split(replace(page_name, '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title FROM posts)
SELECT record_id, CASE WHEN record_id % 2 = 0 THEN topic ELSE page_name END AS code, left(page_name, 3) || '...' AS short, title, CASE WHEN record_id % 2 = 0 THEN topic || '. ' ELSE '' END || title AS coded FROM n""")
def tx15_tx17_names(spark, sf):
    """Labels with and without a code before the name."""
    label = F.when(F.col("record_id") % 2 == 0, F.concat(F.col(TOPIC), F.lit(". "), F.col(PAGE))).otherwise(F.col(PAGE))
    p = posts(spark, sf).withColumn("label", label)
    return p.select("record_id", topic_code("label").alias("code"), preview(PAGE, 3).alias("short"), topic_name("label").alias("title"), topic_name("label", with_code=True).alias("coded"))
