"""Rules for crawled posts: counts, times, reactions, acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.text import follower_count, parsed_count
from ..operators.crawl import accepted, canonical_reaction, labelled_reactions, reaction_columns, total_reactions
from ..operators.ranges import scratch
from .fixture import table
from .catalog import ORACLES, query

#: A count's text by the form that an order's key picks: its digits are the order's and its customer's.
_COUNT_FORMS = ["{n}", "{n},{d}K", "{n}.{d} m", "  {n}B ", "{d} of {n}k", "{n},{d}", "{n},{d},{n}", "about {n}.{d}k", "{p}", "", "none"]


def _filled(forms, at, **parts):
    """The form at a place (a null place gives null), with the parts put in."""
    text = F.get(F.array(*[F.lit(f) for f in forms]), at.cast("int"))
    for name, value in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


_UNIT = "trunc((n || '.' || d)::DOUBLE * {})::BIGINT"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 1000 AS n, o_custkey % 10 AS d, o_orderpriority AS p, o_orderkey // 7 % 12 AS form FROM orders)
SELECT o_orderkey, CASE form WHEN 0 THEN n WHEN 1 THEN {_UNIT.format("1e3")} WHEN 2 THEN {_UNIT.format("1e6")} WHEN 3 THEN n * 1000000000 WHEN 4 THEN d WHEN 5 THEN n WHEN 6 THEN NULL WHEN 7 THEN {_UNIT.format("1e3")}
WHEN 8 THEN left(p, 1)::BIGINT ELSE 0 END AS n FROM o""")
def tx18_parse_count(spark, sf):
    """Counts with commas, points, units and words about them; two commas make no number, texts without digits and nulls are 0."""
    key = F.col("o_orderkey")
    texts = _filled(_COUNT_FORMS, F.floor(key / 7) % (len(_COUNT_FORMS) + 1), n=key % 1000, d=F.col("o_custkey") % 10, p=F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", parsed_count(texts).alias("n"))


_TIME_FORMS = ["{n} phút", "{n} min ago", "{n} giờ trước", "{n} hours", "{n} ngày", "{n} days {p}", "hôm qua lúc {n}", "Yesterday at {n}", "{n} tháng", "{n} năm", "{n} years", "17{k}", "Vừa xong", " JUST NOW {n}m ", "{p}", "   ", "", "hours", "Tuần {n}"]
_HOLDS = lambda *marks: " OR ".join(f"contains(x, '{m}')" for m in marks)
_BACK = "coalesce(now - n * {}, now)"


@query(f"""WITH o AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS now, lower(trim(replace(replace(replace({_TIME_FORMS}[o_orderkey // 7 % {len(_TIME_FORMS) + 1} + 1], '{{n}}', (o_custkey % 90)::VARCHAR), '{{k}}', (10000000 + o_orderkey)::VARCHAR), '{{p}}', o_orderpriority))) AS x FROM orders),
r AS (SELECT *, nullif(regexp_extract(x, '[0-9]+'), '')::BIGINT AS n FROM o)
SELECT o_orderkey, CASE WHEN x IS NULL OR x = '' THEN now WHEN regexp_full_match(x, '[0-9]+') THEN x::BIGINT WHEN {_HOLDS("vừa xong", "just now")} THEN now
WHEN {_HOLDS("phút", "m")} THEN {_BACK.format(60)} WHEN {_HOLDS("giờ", "h")} THEN {_BACK.format(3600)} WHEN {_HOLDS("ngày", "d")} THEN {_BACK.format(86400)} WHEN {_HOLDS("hôm qua")} THEN now - 86400
WHEN {_HOLDS("tháng")} THEN {_BACK.format(30 * 86400)} WHEN {_HOLDS("năm", "year")} THEN {_BACK.format(365 * 86400)} ELSE now END AS t FROM r""")
def d5_relative_time(spark, sf):
    """Times before an order's date, in both languages, with words of the table in them; one letter decides the unit."""
    key = F.col("o_orderkey")
    texts = _filled(_TIME_FORMS, F.floor(key / 7) % (len(_TIME_FORMS) + 1), n=F.col("o_custkey") % 90, k=10_000_000 + key, p=F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", D.relative_time(texts, F.unix_timestamp("o_orderdate")).alias("t"))


@query("SELECT event_id, strftime(to_timestamp(floor(epoch(ts))::BIGINT) AT TIME ZONE 'UTC' + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events")
def d1_local_time(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format(D.local_time(F.unix_timestamp("ts")), "yyyy-MM-dd HH:mm:ss").alias("local"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END AS day, strftime(CASE WHEN year(o_orderdate) = 1995 THEN o_orderdate - INTERVAL 24 MONTH ELSE o_orderdate END, '%Y-%m-%d') AS shifted FROM orders")
def d2_d3_dates(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", D.parsed_date(text).alias("day"), D.shifted_back(F.to_date("o_orderdate"), 1995).alias("shifted"))


#: What stands behind a page's source: each way to tell followers, several at once in any order, and none.
_FOLLOWER_FORMS = ['"follower_count" : {n}', '"page_followers": {"count":{n}}', '"subscribe_count":{n}', "{follower_count: {n}}", '"follower_count_string" : "{n}.{d}"', '"follower_count_string":"7" "subscribe_count":{n}', 'follower_count:5 "page_followers":{ "count" : {n}', '"follower_count":"{n}"', ""]


@query("""SELECT page_id, CASE WHEN page_id % 9 IN (0, 1, 2, 3, 5, 6) THEN page_id * 1001 WHEN page_id % 9 = 4 THEN page_id * 1001 * 10 + page_id % 10 END AS followers FROM pages""")
def tx24_followers(spark, sf):
    """Followers told in a page's source, by the most trusted way that it has, wherever that stands."""
    x = F.concat("html", _filled(_FOLLOWER_FORMS, F.col("page_id") % len(_FOLLOWER_FORMS), n=F.col("page_id") * 1001, d=F.col("page_id") % 10))
    return table(spark, sf, "pages").select("page_id", follower_count(x).alias("followers"))


_SUM = "coalesce(sum(l_quantity) FILTER (WHERE l_linenumber = {}), 0)::BIGINT"


@query(f"SELECT l_orderkey, {_SUM.format(1)} AS \"like\", {_SUM.format(2)} AS love, {_SUM.format(3)} AS haha, 0::BIGINT AS wow, 0::BIGINT AS sad, 0::BIGINT AS angry, 0::BIGINT AS care, CASE WHEN coalesce(sum(l_quantity) FILTER (WHERE l_linenumber <= 3), 0) > 0 THEN (sum(l_quantity) FILTER (WHERE l_linenumber <= 3))::BIGINT ELSE 9 END AS total FROM lineitem GROUP BY 1")
def x3_x4_reaction_map(spark, sf):
    """A post's map of reactions to seven columns, and the checked total."""
    known = F.col("l_linenumber") <= 3
    per = table(spark, sf, "lineitem").groupBy("l_orderkey", F.when(known, F.col("l_linenumber")).alias("k")).agg(F.sum(F.when(known, F.col("l_quantity"))).cast("bigint").alias("n"))
    pair = F.when(F.col("k").isNotNull(), F.struct(F.element_at(F.array(F.lit("like"), F.lit("love"), F.lit("haha")), F.col("k").cast("int")), "n"))
    maps = per.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(pair)).alias("m"))  # three entries at most
    return maps.select("l_orderkey", *reaction_columns(F.col("m")), total_reactions(F.col("m"), F.lit(9)).alias("total"))


_NAMES = ["Thích", "yêu thích", "LOVE it", "haha", "phẫn nộ", "care", "other"]
_CANON = ["like", "like", "love", "haha", "angry", "care", None]


@query("SELECT o_orderkey, [" + ", ".join(f"'{c}'" if c else "NULL" for c in _CANON) + f"][o_orderkey % {len(_NAMES)} + 1] AS reaction FROM orders")
def x5_canonical_reaction(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", canonical_reaction(_filled(_NAMES, F.col("o_orderkey") % len(_NAMES))).alias("reaction"))


#: Names of an item's reaction by its line, and the texts of its label: only those that tell of people count, rounded ones end the reading.
_REACTED = ["Thích", "LOVE", "Haha", "wow!", "Buồn", "Phẫn nộ", "Thương thương"]
_LABEL_FORMS = ["{r}: {n} người", "{n} People reacted with {r}", "{r} {n}", "{n} {r}, {s} times", "reactions of people: {r}", "{n},{d} people: {r}", "{r}: {n} NGƯỜI and {s}"]
_KEYS = "['like', 'love', 'haha', 'wow', 'sad', 'angry', 'care']"


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber AS line, l_quantity::BIGINT AS n, l_suppkey AS s, l_partkey % 10 AS d, l_partkey % 29 AS form FROM lineitem),
u AS (SELECT l_orderkey, {_KEYS}[line] AS key, n, form, line, s, d, form % 7 <> 2 AND form <> 28 AS told, form = 28 OR form % 7 = 3 AND line = 5 AS short FROM i),
e AS (SELECT l_orderkey, min(struct_pack(line := line, n := n, s := s, form := form, d := d)) FILTER (WHERE short) AS cut FROM u GROUP BY 1),
k AS (SELECT u.l_orderkey, key, n FROM u JOIN e ON u.l_orderkey = e.l_orderkey WHERE told AND form % 7 <> 4 AND (cut IS NULL OR struct_pack(line := line, n := n, s := s, form := form, d := d) < cut))
SELECT e.l_orderkey, cut IS NOT NULL AS rounded, {", ".join(f"coalesce(max(n) FILTER (WHERE key = '{r}'), 0)::BIGINT AS {r}" for r in ("love", "haha", "wow", "sad", "angry", "care"))}, coalesce(max(n) FILTER (WHERE key = 'like'), 0)::BIGINT AS "like"
FROM e LEFT JOIN k ON e.l_orderkey = k.l_orderkey GROUP BY ALL""")
def x5_reaction_labels(spark, sf):
    """The labels of a post's items, in their order, read into seven counts; whether a label is rounded, so that the counts after it are unknown.

    A number before a word in k, m or b is taken as rounded, as '12 Buồn' is.
    """
    i = table(spark, sf, "lineitem").withColumns({"n": F.col("l_quantity").cast("bigint"), "d": F.col("l_partkey") % 10, "s": F.col("l_suppkey"), "form": F.col("l_partkey") % 29})
    place = F.when(F.col("form") == 28, len(_LABEL_FORMS)).otherwise(F.col("form") % len(_LABEL_FORMS))
    label = _filled([*_LABEL_FORMS, "{n},{d}K people reacted with {r}"], place, r=_filled(_REACTED, F.col("l_linenumber") - 1), n=F.col("n"), d=F.col("d"), s=F.col("s"))
    posts = i.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "n", "s", "form", "d", label.alias("label")))).alias("items"))  # a dozen items a post
    return posts.select("l_orderkey", labelled_reactions(F.col("items.label")).alias("r")).select("l_orderkey", "r.rounded", *reaction_columns(F.col("r.counts")))


@query("""WITH s AS (SELECT event_id, user_id, ts, value < 20 AS old, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, old ORDER BY n) AS island FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, old, island ORDER BY n) AS run FROM g),
stop AS (SELECT user_id, min(n) AS cut FROM r WHERE old AND run = 3 GROUP BY 1) SELECT event_id FROM r LEFT JOIN stop ON stop.user_id = r.user_id WHERE NOT old AND (cut IS NULL OR n < cut)""")
def f7_accept_rules(spark, sf):
    """Events of a user up to the third old one in a row, old ones left out."""
    e = table(spark, sf, "events").withColumn("old", F.col("value") < 20)
    return accepted(e, "user_id", ["ts", "event_id"], "old", 3).select("event_id")


@query(ORACLES["f7_accept_rules"])
def f7_page_state(spark, sf):
    """The same rules over a stream of two runs, the first with half of the time: what a page's crawler has seen is its state."""
    from ..streaming.incremental import append, follow_pages

    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    folder, target, state = (scratch(spark, x) for x in ("events", "kept", "state"))
    middle = e.agg(F.timestamp_micros(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).cast("bigint")).alias("m")).first().m
    for part in (F.col("ts") < middle, F.col("ts") >= middle):
        e.where(part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(e.schema).parquet(folder)
        append(follow_pages(stream, "user_id", ["ts", "event_id"], F.col("value") < 20, F.lit(True)), target, state).awaitTermination()
    return spark.read.parquet(target).select("event_id")
