"""Data validators and stratified sampling over the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.text import length_bucket, word_count
from ..operators import quality as C
from ..operators import sampling as S
from ..operators.ranges import scratch, stored
from ..sources import readers, sinks
from .captions import docs
from .fixture import PREDICTIONS, TRIALS, predictions, table, trials
from .catalog import query

SEED = 42


@query(f"""WITH {PREDICTIONS}, a AS (SELECT count(*) AS n, count(*) - count(record_id) AS null_id, count(*) - count(DISTINCT record_id) AS dup_id, count(*) FILTER (WHERE y_true IS NULL) AS null_label,
count(*) FILTER (WHERE y_true NOT IN ('T01', 'T02', 'T03', 'T04', 'T05', 'T06', 'T07', 'T08', 'T09')) AS invalid_label, count(DISTINCT y_true) AS n_labels FROM p)
SELECT * FROM (SELECT 'rows' AS "check", n > 0 AS passed, n AS observed FROM a UNION ALL SELECT 'null_id', null_id = 0, null_id FROM a UNION ALL SELECT 'duplicate_id', dup_id = 0, dup_id FROM a
UNION ALL SELECT 'null_label', null_label = 0, null_label FROM a UNION ALL SELECT 'invalid_label', invalid_label = 0, invalid_label FROM a UNION ALL SELECT 'label_coverage', n_labels >= 10, n_labels FROM a)""")
def v2_a30_scenario_checks(spark, sf):
    o, zero = F.col("observed"), F.col("observed") == 0
    valid = [f"T{k:02d}" for k in range(1, 10)]
    return C.checks(
        predictions(spark, sf), rows=(F.count("*"), o > 0), null_id=(F.count_if(F.col("record_id").isNull()), zero), duplicate_id=(F.count("*") - F.count_distinct("record_id"), zero),
        null_label=(F.count_if(F.col("y_true").isNull()), zero), invalid_label=(F.count_if(~F.col("y_true").isin(valid)), zero), label_coverage=(F.count_distinct("y_true"), o >= 10))


_MIN_MAX = "SELECT max(n) - min(n) <= 1 AS balanced, (max(n) - min(n))::BIGINT AS spread FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)"


@query(_MIN_MAX)
def a28_balanced(spark, sf):
    spread = F.max("n") - F.min("n")
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n")).agg((spread <= 1).alias("balanced"), spread.alias("spread"))


@query("SELECT md5(text) AS key, count(DISTINCT lang) AS n_langs, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1 OR count(DISTINCT source) > 1")
def a29_conflicting_duplicates(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.md5("text").alias("key"))
    return d.agg(F.count_distinct("lang").alias("n_langs"), F.count_distinct("source").alias("n_sources")).where("n_langs > 1 or n_sources > 1")


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS present, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, round(avg((l.doc_id IS NOT NULL)::INT), 6) AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def a33_coverage(spark, sf):
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("l"))
    j = table(spark, sf, "documents").join(l, F.col("doc_id") == F.col("l"), "left")
    return j.agg(F.count("l").alias("present"), F.count_if(F.col("l").isNull()).alias("missing"), rounded(F.avg(F.col("l").isNotNull().cast("int"))).alias("coverage"))


@query("SELECT doc_id, (SELECT arg_min(source, doc_id) FROM documents s WHERE s.lang = d.lang AND source <> '') AS name FROM documents d")
def a37_first_name(spark, sf):
    d = table(spark, sf, "documents")
    names = d.where("source <> ''").groupBy("lang").agg(F.min_by("source", "doc_id").alias("name"))
    return d.join(names, "lang", "left").select("doc_id", "name")


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS n_only_a, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS n_only_b")
def u2_u4_same_ids(spark, sf):
    return C.same_ids(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


_DOCS = r"""d AS (SELECT doc_id AS record_id, text AS caption, source AS page_name, lang, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents),
b AS (SELECT *, CASE WHEN words <= 5 THEN 'Very Short (≤5w)' WHEN words <= 15 THEN 'Short (6-15w)' WHEN words <= 50 THEN 'Medium (16-50w)' ELSE 'Long (>50w)' END AS bucket FROM d)"""
_HASH = f"md5('{SEED}:' || record_id), record_id"
QUOTAS = {("en", "Very Short (≤5w)"): 2, ("en", "Short (6-15w)"): 3, ("en", "Medium (16-50w)"): 10, ("en", "Long (>50w)"): 65, ("fr", "Long (>50w)"): 30, ("de", "Long (>50w)"): 20}
_QUOTAS = "q AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {n})" for (a, b), n in QUOTAS.items()) + ") AS q(lang, bucket, quota))"


def bucketed(spark, sf):
    return docs(spark, sf).withColumn("words", word_count("caption")).withColumn("bucket", length_bucket(F.col("words"))).drop("caption")


def quotas(spark):
    return spark.createDataFrame([(a, b, n) for (a, b), n in QUOTAS.items()], "lang string, bucket string, quota int")


# Demonstration keywords over the fixture's languages, from common to rare; a deployment passes its own.
KEYWORDS = dict(zip([f"T{k:02d}" for k in range(1, 19)], ["tha", "sta", "tor", "ess", "able", "ment", "xa", "ung", "qui", "nel", "zu", "fin", "ost", "mir", "pal", "gal", "ight", "mon"], strict=True))
PAIRS = [("T04", "T14"), ("T16", "T05"), ("T01", "T05"), ("T10", "T09"), ("T03", "T05"), ("T06", "T13"), ("T07", "T08"), ("T12", "T14")]
PAGES = {"News": [f"src{k}" for k in range(7)], "Entertainment": [f"src{k}" for k in range(7, 13)]}
GRID = {("News", "Very Short (≤5w)"): 1, ("News", "Short (6-15w)"): 38, ("News", "Medium (16-50w)"): 5, ("News", "Long (>50w)"): 87, ("Entertainment", "Long (>50w)"): 116, ("Other", "Medium (16-50w)"): 2, ("Other", "Long (>50w)"): 1}
_NAMES = sorted(f"{a}_vs_{b}" for a, b in PAIRS)
_FLAGS = "[" + ", ".join(f"contains(lower(caption), '{k}')" for k in KEYWORDS.values()) + "]"
_AT = {t: k + 1 for k, t in enumerate(KEYWORDS)}
_PAGES = "CASE " + " ".join(f"WHEN page_name IN ({', '.join(map(repr, v))}) THEN '{k}'" for k, v in PAGES.items()) + " ELSE 'Other' END"
_ROWS = rf"""{_DOCS}, x AS (SELECT *, {_FLAGS} AS f, {_PAGES} AS source_type, md5('{SEED}:' || record_id) AS h FROM b)"""
_SHORT = "short AS (SELECT * FROM x WHERE words <= 5 ORDER BY h, record_id LIMIT 10)"
_MULTI = "multi AS (SELECT * FROM x WHERE len(list_filter(f[1:17], lambda v: v)) >= 2 AND record_id NOT IN (SELECT record_id FROM short) ORDER BY h, record_id LIMIT 10)"


def _pairs(rows, total=50):
    """The deal to the pairs as a recursion over its turns; deal has turn, pair and took."""
    pools = " UNION ALL ".join(f"SELECT {k} AS p, record_id, h FROM {rows} WHERE f[{_AT[n[:3]]}] AND f[{_AT[n[-3:]]}]" for k, n in enumerate(_NAMES))
    names = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
    return f"""pools AS (SELECT p, list(record_id ORDER BY h, record_id) AS ids FROM (SELECT * FROM ({pools}) QUALIFY row_number() OVER (PARTITION BY p ORDER BY h, record_id) <= {total}) GROUP BY p),
turns AS (SELECT 0 AS step, []::BIGINT[] AS used, NULL::BIGINT AS took, 0 AS idle UNION ALL
  SELECT step + 1, CASE WHEN x IS NULL THEN used ELSE list_append(used, x) END, x, CASE WHEN x IS NULL THEN idle + 1 ELSE 0 END
  FROM (SELECT t.*, list_filter(coalesce(ids, []), lambda i: NOT list_contains(used, i))[1] AS x FROM turns t LEFT JOIN pools ON p = step % {len(_NAMES)}) WHERE len(used) < {total} AND idle < {len(_NAMES)}),
deal AS (SELECT took AS record_id, {names}[(step - 1) % {len(_NAMES)} + 1] AS pair, (len(used) - 1)::INT AS turn FROM turns WHERE took IS NOT NULL)"""


def _covered(rows, per=10):
    """The labels' candidates as a recursion over the labels; cover has record_id, label and n_other."""
    pools = " UNION ALL ".join(f"SELECT {k} AS l, record_id, len(list_filter(f, lambda v: v)) - 1 AS n_other FROM {rows} WHERE f[{k}]" for k in range(1, 19))
    names = "[" + ", ".join(f"'{t}'" for t in KEYWORDS) + "]"
    return f"""wanted AS (SELECT * FROM ({pools}) QUALIFY row_number() OVER (PARTITION BY l ORDER BY n_other, record_id) <= {per * 18}),
lists AS (SELECT l, list(record_id ORDER BY n_other, record_id) AS ids FROM wanted GROUP BY l),
taking AS (SELECT 0 AS label, []::BIGINT[] AS used, []::BIGINT[] AS took UNION ALL
  SELECT label + 1, list_concat(used, x), x FROM (SELECT t.*, list_filter(coalesce(ids, []), lambda i: NOT list_contains(used, i))[1:{per}] AS x FROM taking t LEFT JOIN lists ON l = label + 1) WHERE label < 18),
took AS (SELECT label, unnest(took) AS record_id FROM taking),
cover AS (SELECT t.record_id, {names}[label] AS label, n_other::INT AS n_other FROM took t JOIN wanted w ON w.record_id = t.record_id AND w.l = label)"""


_GRID = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {n})" for (a, b), n in GRID.items()) + ") AS g(source_type, bucket, quota))"
_NOT = lambda *names: " AND ".join(f"record_id NOT IN (SELECT record_id FROM {n})" for n in names)
_TOPIC_NAMES = "list_filter([" + ", ".join(f"CASE WHEN f[{k}] THEN 'T{k:02d}' END" for k in range(1, 18)) + "], lambda v: v IS NOT NULL)"
PILOT = f"""{_ROWS}, {_SHORT}, {_MULTI}, free AS (SELECT * FROM x WHERE {_NOT("short", "multi")}), {_pairs("free")}, open AS (SELECT * FROM free WHERE {_NOT("deal")}), {_covered("open")}, {_GRID},
base AS (SELECT o.*, quota, row_number() OVER (PARTITION BY o.source_type, o.bucket ORDER BY h, record_id) AS n FROM open o JOIN grid g ON o.source_type = g.source_type AND o.bucket = g.bucket WHERE {_NOT("cover")}),
pilot AS (SELECT record_id, 'D_Hard_Cases' AS strata_label, 'D_Hard_Cases_VeryShort' AS sampling_method, 'none' AS candidate_label, 'word_count: ' || words AS candidate_reason FROM short
  UNION ALL SELECT record_id, 'D_Hard_Cases', 'D_Hard_Cases_MultiTopic', 'none', 'matched topics: ' || array_to_string({_TOPIC_NAMES}, ', ') FROM multi
  UNION ALL SELECT record_id, 'C_Boundary_Pairs', 'C_Boundary_Pairs', 'none', 'boundary pair: ' || pair FROM deal
  UNION ALL SELECT record_id, 'B_Candidate_Coverage', 'B_Candidate_Coverage', label, 'other labels: ' || n_other FROM cover
  UNION ALL SELECT record_id, 'A_Random_Baseline', 'A_Random_Baseline', 'none', 'source_type: ' || source_type || ', bucket: ' || bucket FROM base WHERE n <= quota),
hashed AS (SELECT *, md5('{SEED}:' || record_id) AS h, (SELECT count(*) = 500 FROM pilot) AS designed FROM pilot),
twice AS (SELECT candidate_label FROM (SELECT DISTINCT candidate_label FROM pilot WHERE strata_label = 'B_Candidate_Coverage') ORDER BY md5('{SEED}:' || candidate_label) LIMIT 12),
ranked AS (SELECT *, row_number() OVER (PARTITION BY strata_label ORDER BY h, record_id) AS n, row_number() OVER (PARTITION BY strata_label, candidate_label ORDER BY h, record_id) AS m FROM hashed),
chosen AS (SELECT record_id FROM ranked WHERE n <= CASE WHEN designed THEN CASE strata_label WHEN 'A_Random_Baseline' THEN 50 WHEN 'C_Boundary_Pairs' THEN 10 WHEN 'D_Hard_Cases' THEN 4 ELSE 0 END
  ELSE CASE strata_label WHEN 'A_Random_Baseline' THEN 60 WHEN 'C_Hard_Edge_Cases' THEN 10 ELSE 0 END END
  OR (strata_label = 'B_Candidate_Coverage' AND m <= CASE WHEN designed OR candidate_label IN (SELECT candidate_label FROM twice) THEN 2 ELSE 1 END)),
filled AS (SELECT record_id FROM chosen UNION ALL SELECT record_id FROM (SELECT record_id, designed, row_number() OVER (ORDER BY h, record_id) AS n FROM hashed WHERE record_id NOT IN (SELECT record_id FROM chosen))
  WHERE NOT designed AND n <= 100 - (SELECT count(*) FROM chosen)),
phased AS (SELECT pilot.*, CASE WHEN record_id IN (SELECT record_id FROM filled) THEN 'Phase_1' ELSE 'Phase_2' END AS pilot_phase FROM pilot)"""


def flags():
    return [(t, F.contains(F.lower("caption"), F.lit(k))) for t, k in KEYWORDS.items()]


def flagged(spark, sf):
    """Rows with the flags of all labels, without their texts."""
    rows = docs(spark, sf).withColumn("words", word_count("caption"))
    kind = F.lit("Other")
    for name, pages in PAGES.items():
        kind = F.when(F.col("page_name").isin(pages), name).otherwise(kind)
    return rows.select("record_id", "page_name", "lang", "words", length_bucket(F.col("words")).alias("bucket"), kind.alias("source_type"), F.array(*[c for _, c in flags()]).alias("f"))


def labels():
    return [(t, F.get("f", F.lit(k))) for k, t in enumerate(KEYWORDS)]


def pairs():
    own = dict(labels())
    return [(f"{a}_vs_{b}", own[a] & own[b]) for a, b in PAIRS]


def pilot(spark, sf):
    grid = spark.createDataFrame([(a, b, n) for (a, b), n in GRID.items()], "source_type string, bucket string, quota int")
    return S.pilot_set(flagged(spark, sf), "record_id", SEED, F.col("words") <= 5, labels()[:17], labels(), pairs(), grid, ["source_type", "bucket"])


@query(f"WITH {_ROWS}, {_SHORT}, {_MULTI} SELECT record_id, words::INT AS words, 'short' AS method FROM short UNION ALL SELECT record_id, words::INT, 'multi-topic' FROM multi")
def p1_hard_cases(spark, sf):
    rows = stored(flagged(spark, sf), "rows")
    order = [S.shuffle_key("record_id", SEED), F.col("record_id")]
    short = stored(rows.where("words <= 5").orderBy(*order).limit(10), "short")
    topics = F.size(F.filter(F.slice("f", 1, 17), lambda v: v))
    multi = S.remainder(rows.where(topics >= 2), short, "record_id").orderBy(*order).limit(10)
    return short.select("record_id", "words", F.lit("short").alias("method")).unionByName(multi.select("record_id", "words", F.lit("multi-topic").alias("method")))


@query(f"WITH {_DOCS}, {_QUOTAS}, s AS (SELECT b.*, quota, row_number() OVER (PARTITION BY b.lang, b.bucket ORDER BY {_HASH}) AS n FROM b JOIN q ON b.lang = q.lang AND b.bucket = q.bucket) SELECT record_id, lang, bucket FROM s WHERE n <= quota")
def p4_quota_grid(spark, sf):
    return S.quota_grid(bucketed(spark, sf), quotas(spark), ["lang", "bucket"], "record_id", SEED).select("record_id", "lang", "bucket")


@query(f"WITH {_DOCS}, {_QUOTAS}, s AS (SELECT b.*, quota, row_number() OVER (PARTITION BY b.lang, b.bucket ORDER BY {_HASH}) AS n FROM b JOIN q ON b.lang = q.lang AND b.bucket = q.bucket) SELECT count(*) AS n_pool FROM b WHERE record_id NOT IN (SELECT record_id FROM s WHERE n <= quota)")
def p5_pool(spark, sf):
    b = bucketed(spark, sf)
    taken = S.quota_grid(b, quotas(spark), ["lang", "bucket"], "record_id", SEED)
    return S.remainder(b, taken, "record_id").agg(F.count("*").alias("n_pool"))


@query(f"WITH RECURSIVE {PILOT} SELECT * FROM phased")
def p6_phase_split(spark, sf):
    """The whole pilot, its four strata, and the phase of each row."""
    return S.phase_split(stored(pilot(spark, sf), "pilot"), "record_id", SEED)


@query(f"WITH RECURSIVE {_ROWS}, {_pairs('x')} SELECT * FROM deal")
def p2_round_robin(spark, sf):
    return S.round_robin(flagged(spark, sf), pairs(), 50, "record_id", SEED)


@query(f"WITH RECURSIVE {_ROWS}, {_covered('x')} SELECT * FROM cover")
def p3_greedy_labels(spark, sf):
    return S.greedy_labels(flagged(spark, sf), labels(), 10, "record_id")


@query(f"WITH {_DOCS} SELECT record_id FROM b")
def p7_shuffle(spark, sf):
    """The whole set in hash order; order itself is checked in the tests."""
    return bucketed(spark, sf).orderBy(S.shuffle_key("record_id", SEED), "record_id").select("record_id")


_DIMS = ("strata_label", "sampling_method", "candidate_label", "pilot_phase", "strata_phase", "source_type", "bucket", "page_name", "lang")
_DIM = " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 6) AS pct FROM r GROUP BY ALL" for c in _DIMS)


@query(f"""WITH RECURSIVE {PILOT}, r AS (SELECT p.*, strata_label || ' / ' || pilot_phase AS strata_phase, source_type, bucket, page_name, lang FROM phased p JOIN x ON p.record_id = x.record_id)
{_DIM} UNION ALL SELECT 'page_missing', page_name, 0, 0 FROM (SELECT DISTINCT page_name FROM x WHERE page_name NOT IN (SELECT page_name FROM r))""")
def a43_sampling_report(spark, sf):
    """Counts and shares of the pilot by each dimension, the strata of each phase, and pages that it lacks."""
    rows = stored(flagged(spark, sf).drop("f"), "rows")
    phased = S.phase_split(stored(pilot(spark, sf), "pilot"), "record_id", SEED)
    r = stored(phased.withColumn("strata_phase", F.concat_ws(" / ", "strata_label", "pilot_phase")).join(rows, "record_id"), "report")
    long = r.unpivot([], list(_DIMS), "dimension", "value").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    total = long.groupBy("dimension").agg(F.sum("n").alias("total"))
    missing = rows.select("page_name").distinct().join(r.select("page_name"), "page_name", "left_anti")
    out = long.join(total, "dimension").select("dimension", "value", "n", rounded(F.col("n") * 100.0 / F.col("total")).alias("pct"))
    return out.unionByName(missing.select(F.lit("page_missing").alias("dimension"), F.col("page_name").alias("value"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("pct")))


_METADATA = ["source_type", "word_count", "content_length_bucket", "strata_label", "sampling_method", "candidate_label", "candidate_reason"]
# The columns that annotators and the adjudicator fill in.
SCAFFOLD = [*[f"annotator_{k}_{c}" for k in (1, 2, 3) for c in ("topic_label", "topic_id", "note")], "flag_ambiguity", "is_disagreement", "adjudicator_reason"]
PHASES = (({"A_Random_Baseline": 50, "B_Candidate_Coverage": 36, "C_Boundary_Pairs": 10, "D_Hard_Cases": 4}, {2}), ({"A_Random_Baseline": 200, "B_Candidate_Coverage": 144, "C_Boundary_Pairs": 40, "D_Hard_Cases": 16}, {8}))
BUCKETS = ["Very Short (≤5w)", "Short (6-15w)", "Medium (16-50w)", "Long (>50w)"]
CHECKED = C.Plan(500, _METADATA, SCAFFOLD, ["News", "Entertainment", "Other"], BUCKETS, PHASES)


def _phase_sql():
    parts = []
    for k, (strata, each) in enumerate(PHASES, 1):
        own = f"(SELECT * FROM phased WHERE pilot_phase = 'Phase_{k}')"
        wrong = " OR ".join(f"(SELECT count(*) FROM {own} WHERE strata_label = '{s}') <> {n}" for s, n in strata.items())
        by_label = f"SELECT count(*) AS n FROM {own} WHERE strata_label = 'B_Candidate_Coverage' GROUP BY candidate_label"
        parts += [(f"size of phase {k}", f"(SELECT count(*) FROM {own}) <> " + ("100" if k == 1 else "(SELECT count(*) - 100 FROM phased)")), (f"strata of phase {k}", wrong), (f"labels of phase {k}", f"(SELECT count(*) <> 18 OR count(*) FILTER (WHERE n NOT IN ({', '.join(map(str, each))})) > 0 FROM ({by_label}))")]
    return " UNION ALL ".join(f"SELECT '{n}' AS id WHERE {c}" for n, c in parts)


@query(f"""WITH RECURSIVE {PILOT}, pages AS (SELECT DISTINCT page_name AS id FROM x WHERE page_name NOT IN (SELECT page_name FROM x WHERE record_id IN (SELECT record_id FROM phased))), phases AS ({_phase_sql()})
SELECT 'size' AS "check", abs(n - 500) <= 10 AS passed, n AS observed, '' AS sample FROM (SELECT count(*) AS n FROM phased)
UNION ALL SELECT unnest(['conservation', 'no_duplicates', 'no_leakage', 'all_accounted_for', 'strata_not_null', 'strata_disjoint', 'metadata', 'scaffold_present', 'scaffold_absent', 'ids_match', 'no_null_ids']), true, 0, ''
UNION ALL SELECT 'page_coverage', count(*) = 0, count(*), coalesce(array_to_string(list_sort(list(id))[1:5], ', '), '') FROM pages
UNION ALL SELECT 'phases', count(*) = 0, count(*), coalesce(array_to_string(list_sort(list(id))[1:5], ', '), '') FROM phases""")
def v1_sampling_checks(spark, sf):
    """The fourteen rules over the pilot, the files of which are written and read again."""
    rows = stored(flagged(spark, sf).withColumnsRenamed({"words": "word_count", "bucket": "content_length_bucket"}).drop("f"), "rows")
    phased = stored(S.phase_split(stored(pilot(spark, sf), "pilot"), "record_id", SEED), "phased")
    full = stored(rows.join(F.broadcast(phased), "record_id").withColumns({c: F.lit("") for c in SCAFFOLD}), "full")
    pool = stored(S.remainder(rows, F.broadcast(phased), "record_id"), "left")
    phases = [full.where(F.col("pilot_phase") == f"Phase_{k}") for k in (1, 2)]
    files = [f"{scratch(spark, 'ids')}/{k}" for k in range(3)]
    for path, df in zip(files, (full, *phases), strict=True):
        sinks.to_csv(df, path, ["record_id", "strata_label"], mark=True)
    ids = [readers.csv(spark, path, "record_id bigint, strata_label string") for path in files]
    return C.sampling_checks(rows, full, pool, ids[0], phases, ids[1:], CHECKED)


_SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END"
_LABELLED = f"""s0 AS (SELECT {_SPLIT} AS split, doc_id::VARCHAR AS id, CASE WHEN doc_id % 53 <> 0 THEN 'T' || lpad((doc_id * 7 % 19 + 1)::VARCHAR, 2, '0') END AS label, CASE WHEN doc_id % 101 <> 0 THEN text END AS text FROM documents),
s AS (SELECT split, id, label, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, text IS NULL AS no_text FROM (SELECT * FROM s0 UNION ALL SELECT 'val', id, label, text FROM s0 WHERE split = 'train' AND id::BIGINT % 97 = 0
  UNION ALL SELECT 'train', id, 'T01', text FROM s0 WHERE split = 'train' AND id::BIGINT % 61 = 0)),
k AS (SELECT *, nullif(coalesce(text, ''), '') AS key FROM s),
i AS (SELECT split, id, count(*) AS n, count(key) AS n_text, count(DISTINCT label) > 1 OR count(DISTINCT coalesce(key, '')) > 1 AS conflict FROM k GROUP BY ALL),
m AS (SELECT id, bit_or(bit) AS mask FROM (SELECT id, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 4 END AS bit FROM i WHERE n_text > 0 UNION ALL SELECT id, 8 FROM s0 WHERE split = 'test' AND id::BIGINT % 19 <> 0) GROUP BY id),
t AS (SELECT key, bit_or(CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 4 END) AS mask FROM k WHERE key IS NOT NULL GROUP BY key),
c AS (SELECT split, label, count(*) AS n FROM k WHERE key IS NOT NULL AND label IS NOT NULL GROUP BY ALL)"""
_VALID = [f"T{k:02d}" for k in range(1, 18)]
_IN = "(" + ", ".join(map(repr, _VALID)) + ")"


def _counter(name, value, split="split", source="k GROUP BY split", passed="n = 0"):
    return f"""SELECT '{name}' AS "check", split, {passed} AS passed, n::BIGINT AS observed FROM (SELECT {split} AS split, {value} AS n FROM {source})"""


_V2 = " UNION ALL ".join([
    _counter("rows", "count(*)", passed="n > 0"), _counter("null_id", "count(*) FILTER (WHERE id IS NULL)"), _counter("null_text", "count(*) FILTER (WHERE no_text)"), _counter("empty_text", "count(*) FILTER (WHERE key IS NULL)"),
    _counter("null_label", "count(*) FILTER (WHERE label IS NULL)"), _counter("removed_label", "count(*) FILTER (WHERE label = 'T18')"), _counter("invalid_label", f"count(*) FILTER (WHERE label NOT IN {_IN} AND label <> 'T18')"),
    _counter("duplicate_id", "sum(n - 1)", source="i GROUP BY split"), _counter("conflicting_duplicates", "count(*) FILTER (WHERE conflict AND n > 1)", source="i GROUP BY split"),
    _counter("missing_classes", f"17 - count(*) FILTER (WHERE label IN {_IN})", source="c GROUP BY split"), _counter("balanced", "max(n) - min(n)", source="c GROUP BY split", passed="n <= 1"),
    *[_counter(f"{what}_overlap_{p}", f"count(*) FILTER (WHERE mask & {b} = {b})", "'all'", source) for what, source in (("id", "m"), ("text", "t")) for p, b in (("train_val", 3), ("train_test", 5), ("val_test", 6))],
    _counter("missing_from_test", "count(*) FILTER (WHERE mask & 8 = 8 AND mask & 4 = 0)", "'all'", "m"), _counter("extra_in_test", "count(*) FILTER (WHERE mask & 4 = 4 AND mask & 8 = 0)", "'all'", "m")])


@query(f"WITH {_LABELLED} {_V2}")
def v2_scenario_splits(spark, sf):
    """All counters of a scenario's three splits: documents dealt by id, some of them leaked to another split or repeated with another label."""
    i = F.col("doc_id")
    split = F.when(i % 10 < 7, "train").when(i % 10 < 9, "val").otherwise("test")
    base = table(spark, sf, "documents").select(split.alias("split"), i.cast("string").alias("record_id"), F.when(i % 53 != 0, F.concat(F.lit("T"), F.lpad((i * 7 % 19 + 1).cast("string"), 2, "0"))).alias("label"), F.when(i % 101 != 0, F.col("text")).alias("text"))
    n = F.col("record_id").cast("bigint")
    leaked = base.where((F.col("split") == "train") & (n % 97 == 0)).withColumn("split", F.lit("val"))
    again = base.where((F.col("split") == "train") & (n % 61 == 0)).withColumn("label", F.lit("T01"))
    return C.scenario_checks(base.unionByName(leaked).unionByName(again), base.where((F.col("split") == "test") & (n % 19 != 0)).select("record_id"), _VALID, "T18")


_V3 = "f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY scenario, model_name ORDER BY trial_id DESC) = 1)"


@query(f"""WITH {TRIALS}, {_V3}, n AS (SELECT (SELECT count(*) FROM f) AS rows, 20 - (SELECT count(*) FROM f WHERE scenario <= 'S4' AND model_name <= 'M3') AS missing, (SELECT count(*) FROM f WHERE scenario > 'S4' OR model_name > 'M3') AS unexpected,
(SELECT count(*) FROM f WHERE status <> 'success') AS failed, (SELECT count(*) FROM f WHERE macro_f1_val IS NULL OR weighted_f1_val IS NULL OR accuracy_val IS NULL) AS null_metric)
SELECT 'rows' AS "check", rows = 20 AS passed, rows AS observed FROM n UNION ALL SELECT 'missing', missing = 0, missing FROM n UNION ALL SELECT 'unexpected', unexpected = 0, unexpected FROM n UNION ALL SELECT 'repeated', true, 0 FROM n
UNION ALL SELECT 'failed', failed = 0, failed FROM n UNION ALL SELECT 'null_metric', null_metric = 0, null_metric FROM n""")
def v3_result_checks(spark, sf):
    """The last trial of each scenario and model as its result: twenty rows, all of them successful, without null metrics."""
    keys = ["scenario", "model_name"]
    last = trials(spark, sf).groupBy(*keys).agg(F.max_by(F.struct("status", "macro_f1_val", "weighted_f1_val", "accuracy_val"), "trial_id").alias("last")).select(*keys, "last.*")
    return C.matrix_checks(last, {"scenario": [f"S{k}" for k in range(5)], "model_name": [f"M{k}" for k in range(4)]}, ["macro_f1_val", "weighted_f1_val", "accuracy_val"])


@query(f"WITH {PREDICTIONS}, m AS (SELECT scenario, model_name, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT 'S' || s AS scenario, 'M' || k AS model_name FROM (SELECT unnest(range(5)) AS s), (SELECT unnest(range(4)) AS k)) SELECT count(*) AS expected, count(m.n) AS found, count(*) FILTER (WHERE m.n IS NULL) AS missing FROM g LEFT JOIN m ON m.scenario = g.scenario AND m.model_name = g.model_name")
def v3_result_matrix(spark, sf):
    keys = ["scenario", "model_name"]
    grid = spark.range(20).select(F.concat(F.lit("S"), F.col("id") % 5).alias("scenario"), F.concat(F.lit("M"), F.floor(F.col("id") / 5)).alias("model_name"))
    found = predictions(spark, sf).groupBy(*keys).agg(F.count("*").alias("n"))
    return grid.join(found, keys, "left").agg(F.count("*").alias("expected"), F.count("n").alias("found"), F.count_if(F.col("n").isNull()).alias("missing"))


_PAIRS = "x AS (SELECT record_id, string_split(page_name || ';' || lang, ';') AS c FROM b)"


@query(f"WITH {_DOCS}, {_PAIRS}, k AS (SELECT least(c[1], c[2]) AS a, greatest(c[1], c[2]) AS b, record_id FROM x WHERE len(c) = 2) SELECT a, b, count(*) AS n, array_to_string(list_slice(list_sort(list(record_id)), 1, 2), ';') AS examples FROM k GROUP BY ALL")
def a17_conflict_pairs(spark, sf):
    d = docs(spark, sf).select("record_id", F.split(F.concat_ws(";", "page_name", "lang"), ";").alias("c")).where(F.size("c") == 2)
    pair = d.select("record_id", F.least(F.get("c", F.lit(0)), F.get("c", F.lit(1))).alias("a"), F.greatest(F.get("c", F.lit(0)), F.get("c", F.lit(1))).alias("b"))
    least = pair.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("record_id").alias("first"))
    # the second least in a second pass, so that no task ranks a whole pair
    others = pair.join(least.select("a", "b", "first"), ["a", "b"])
    second = others.groupBy("a", "b").agg(F.when(F.count_if(F.col("record_id") == F.col("first")) > 1, F.min("first")).otherwise(F.min(F.when(F.col("record_id") > F.col("first"), F.col("record_id")))).alias("second"))
    return least.join(second, ["a", "b"]).select("a", "b", "n", F.concat_ws(";", F.col("first").cast("string"), F.col("second").cast("string")).alias("examples"))


_LANGS = ["de", "en", "es", "fr"]


@query("WITH k AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), e AS (SELECT DISTINCT least(x.lang, y.lang) AS a, greatest(x.lang, y.lang) AS b, x.source FROM k x JOIN k y ON x.source = y.source AND x.lang < y.lang), c AS (SELECT a, b, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT a, b, n FROM c UNION ALL SELECT b, a, n FROM c), l AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS a) SELECT l.a AS label, "
       + ", ".join(f"CASE WHEN l.a = '{x}' THEN -1 ELSE coalesce((SELECT sum(n) FROM s WHERE s.a = l.a AND s.b = '{x}'), 0) END::BIGINT AS {x}" for x in _LANGS) + " FROM l")
def a18_conflict_matrix(spark, sf):
    k = table(spark, sf, "documents").select("source", "lang").distinct()
    other = k.withColumnRenamed("lang", "other")
    both = k.join(other, "source").where("lang <> other")
    wide = both.groupBy(F.col("lang").alias("label")).pivot("other", _LANGS).count()
    return wide.select("label", *[F.when(F.col("label") == x, -1).otherwise(F.coalesce(F.col(x), F.lit(0))).cast("bigint").alias(x) for x in _LANGS])


@query("SELECT source AS name, count(*) AS n, list_position(['src3', 'src1', 'src2'], source)::INT AS place FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY ALL")
def k4_custom_order(spark, sf):
    from ..functions.numbers import ordinal

    return table(spark, sf, "documents").where(F.col("source").isin("src1", "src2", "src3")).groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).withColumn("place", ordinal("name", ["src3", "src1", "src2"]))


@query(f"WITH {_DOCS} SELECT record_id, words::INT AS words FROM b QUALIFY row_number() OVER (ORDER BY words, record_id) <= 10")
def k5_head_ascending(spark, sf):
    return bucketed(spark, sf).orderBy("words", "record_id").limit(10).select("record_id", "words")
