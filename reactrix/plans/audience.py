"""Hour, weekday and page charts over posts and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import WEEK
from ..functions.numbers import long_or_zero, ordinal, ratio, rounded
from ..operators.evaluation import label_grid
from ..operators.ranges import quantiles, stored
from .fixture import POSTS, posts, table
from .catalog import query


@query(f"WITH {POSTS} SELECT coalesce(post_created_hour, 0) AS hour, count(*) AS n, median(total_reactions)::DOUBLE AS reactions, median(comment_count)::DOUBLE AS comments, median(share_count)::DOUBLE AS shares FROM posts GROUP BY 1")
def a8_d4_hourly_medians(spark, sf):
    p = posts(spark, sf).select(long_or_zero("post_created_hour").cast("int").alias("hour"), F.col("total_reactions").alias("reactions"), F.col("comment_count").alias("comments"), F.col("share_count").alias("shares"))
    return hourly_medians(p, ["reactions", "comments", "shares"])


def hourly_medians(posts_, metrics):
    """hour, n, and the median of each metric: one pass over the posts, whose metrics are one long column."""
    long = posts_.withColumn("n", F.lit(1)).unpivot(["hour"], ["n", *metrics], "metric", "value")
    counts = stored(long.groupBy("hour", "metric", "value").agg(F.count("*").alias("times")), "metrics")
    mid = quantiles(counts.where("metric <> 'n'"), ["metric", "hour"], "value", times="times", mid=0.5)
    wide = mid.groupBy("hour").agg(*[F.max(F.when(F.col("metric") == m, F.col("mid"))).alias(m) for m in metrics])
    return counts.where("metric = 'n'").select("hour", F.col("times").alias("n")).join(wide, "hour", "left")


_EV = "ev AS (SELECT hour(ts)::INT AS hour, dayname(ts) AS weekday, value FROM events)"


def events(spark, sf):
    return table(spark, sf, "events").select(F.hour("ts").alias("hour"), F.date_format("ts", "EEEE").alias("weekday"), "value", "event_type", "user_id", "ts", "event_id")


def cell_medians(ev):
    return ev.groupBy("weekday", "hour").agg(F.count("*").alias("n")).join(quantiles(ev, ["weekday", "hour"], "value", m=0.5), ["weekday", "hour"], "left")


@query(f"""WITH {_EV}, c AS (SELECT weekday, hour, median(value) AS m, count(*) AS n FROM ev GROUP BY ALL),
g AS (SELECT d.weekday, h.hour::INT AS hour FROM (SELECT unnest({WEEK}) AS weekday) d, (SELECT unnest(range(24)) AS hour) h)
SELECT g.weekday, g.hour, coalesce(n, 0) AS n, round(CASE WHEN n >= 15 THEN m END, 6) AS median_value FROM g LEFT JOIN c ON g.weekday = c.weekday AND g.hour = c.hour""")
def a9_j11_weekday_hour_grid(spark, sf):
    cells = cell_medians(events(spark, sf))
    grid = label_grid(spark, WEEK, "weekday").select("weekday", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return grid.join(cells, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"), rounded(F.when(F.col("n") >= 15, F.col("m"))).alias("median_value"))


@query(f"""WITH {_EV}, c AS (SELECT weekday, hour, median(value) AS m, count(*) AS n FROM ev GROUP BY ALL), a AS (SELECT median(value) AS m FROM ev)
SELECT c.weekday, c.hour, round(c.m / a.m, 6) AS lift FROM c, a WHERE n >= 15 ORDER BY round(c.m, 9) DESC, list_position({WEEK}, c.weekday), c.hour LIMIT 1""")
def a9_best_cell(spark, sf):
    ev = events(spark, sf)
    whole = quantiles(ev, [], "value", m=0.5).first()[0]
    best = cell_medians(ev).where("n >= 15").orderBy(F.round("m", 9).desc(), ordinal("weekday", WEEK), "hour").limit(1)
    return best.select("weekday", "hour", rounded(ratio("m", F.lit(whole))).alias("lift"))


@query(f"WITH {POSTS} SELECT CASE WHEN post_created_weekday IN ('Saturday', 'Sunday') THEN 'weekend' ELSE 'weekday' END AS part, median(total_reactions)::DOUBLE AS reactions, count(*) AS n FROM posts GROUP BY 1")
def a10_weekend(spark, sf):
    part = F.when(F.col("post_created_weekday").isin("Saturday", "Sunday"), "weekend").otherwise("weekday")
    p = posts(spark, sf).withColumn("part", part)
    return p.groupBy("part").agg(F.count("*").alias("n")).join(quantiles(p, ["part"], "total_reactions", reactions=0.5), "part", "left").select("part", "reactions", "n")


_HOURS = ", ".join(f"count(*) FILTER (WHERE hour = {h}) AS h{h}" for h in range(24))


@query(f"WITH {_EV} SELECT weekday, {_HOURS} FROM ev GROUP BY 1")
def x8_pivot_hours(spark, sf):
    wide = events(spark, sf).groupBy("weekday").pivot("hour", list(range(24))).count()
    return wide.select("weekday", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h}") for h in range(24)])


@query("SELECT json_extract_string(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1")
def x9_json_fields(spark, sf):
    return table(spark, sf, "events").select(F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT event_id, to_json({'t': event_type, 'u': user_id})::VARCHAR AS packed FROM events")
def x9_json_encode(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("t"), F.col("user_id").alias("u"))).alias("packed"))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def a15_event_days(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("mean_value"))


@query(f"""WITH {POSTS}, h AS (SELECT post_created_hour AS hour, count(*) AS n, median(total_reactions) AS m FROM posts WHERE post_created_hour IS NOT NULL GROUP BY 1)
SELECT hour, n, m::DOUBLE AS reactions FROM h WHERE n >= 15 ORDER BY m DESC, hour LIMIT 3""")
def k1_top_hours(spark, sf):
    p = posts(spark, sf).where("post_created_hour is not null").select(F.col("post_created_hour").alias("hour"), F.col("total_reactions").alias("reactions"))
    return hourly_medians(p, ["reactions"]).where("n >= 15").orderBy(F.col("reactions").desc(), "hour").limit(3)


@query("SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def w8_u5_first_event(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id", "rn")
