"""Secret scans with corpus-wide ownership frequency.

One scan of the texts finds candidates of every kind with their spans. The SHA-256 of the candidates are then counted over the whole
corpus by distinct repositories and owners. A value of more than MAX_OWNERS owners is a widely copied example, and so is one that several
owners hold in more than MAX_REPOSITORIES repositories; what a single owner holds, in however many repositories, or few owners in few, is a
live-looking credential. Base kinds always report their spans; further kinds add a span only where the value looks live.

Spans are of whole matches, in code points, end exclusive. Counting deduplicates (hash, owner) and (hash, repository)
with map-side combined aggregates before it counts, and counts go back to the spans by spread_join(), so a value that a third of all rows hold is no hot group.

Defined results: null and empty texts have no spans; a null owner or repository isn't counted; repeated rows get equal results; spans that start at one place are listed by kind;
very long texts are scanned whole, at a cost in proportion to their length; extra columns stay (redact) or are left out; empty tables give empty results. Columns other than doc_id, text and the two named ones aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_of, let, materialize, meet, packed, running_array, spread_join, text_key

# Fixed values of the base kinds: pattern, group that is the value, least length of the value.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Kinds that the ownership method adds where the value looks live.
ADDED = {
    "forge": (r"gh[pousr]_[A-Za-z0-9]{30,}", 0, 34),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 26),
    "login": (r"://[^\s/:@]{1,64}:([^\s/:@]{6,})@", 1, 6),
}
KINDS = [*BASE, *ADDED]
#: A value of more owners than this is copied; of several owners also if it is in more repositories.
MAX_OWNERS, MAX_REPOSITORIES = 2, 8
#: Quick tests that every text with a match passes.
HINTS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "hex": "[0-9a-f]{16}"}
NEEDLES = {"access": "AKIA", "forge": "gh", "jwt": "eyJ", "login": "://"}
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:binary>>"


def spans_of(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of one kind whose value is long enough, as SPAN.

    The text cut at the matches and the matches themselves alternate, so their lengths add up to the places.
    """
    pattern, group, least = {**BASE, **ADDED}[kind]
    if kind == "hex":
        pattern = "[0-9a-f]{16,}"  # the same maximal runs
    number = KINDS.index(kind)
    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def places(f):
        steps = F.zip_with(f["whole"], F.slice(f["gaps"], F.lit(1), F.size(f["whole"])), lambda w, g: (F.length(g) + F.length(w)).cast("bigint"))
        ends = running_array(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
        spans = F.zip_with(F.zip_with(ends, f["whole"], lambda e, w: F.struct(e.alias("e"), F.length(w).cast("bigint").alias("n"))), f["value"], lambda x, v: F.struct((x["e"] - x["n"]).alias("start"), F.lit(number).alias("kind"), x["e"].alias("end"), v.alias("value")))
        return F.transform(F.filter(spans, lambda s: F.length(s["value"]) >= least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.unhex(F.sha2(s["value"], 256)).alias("value")))

    hint = F.contains(text, F.lit(NEEDLES[kind])) if kind in NEEDLES else text.rlike(HINTS[kind])
    return F.when(hint, let(found, places)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """doc_id, h, owner, repository, spans (start, kind, end, SHA-256 of the value) of every row; the texts and values are left behind."""
    wide = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("h"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.coalesce("text", F.lit("")).alias("text"))
    return wide.select("doc_id", "h", "owner", "repository", F.sort_array(F.concat(*[spans_of(F.col("text"), k) for k in KINDS])).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """value, n_owners, n_repositories over the whole corpus, and n: the spans that have it."""
    held = found.where(F.size("spans") > 0).select("owner", "repository", F.explode("spans").alias("s")).select(F.col("s.value").alias("value"), "owner", "repository")
    who = F.array(F.struct(F.lit(True).alias("of_owner"), F.col("owner").alias("who")), F.struct(F.lit(False).alias("of_owner"), F.col("repository").alias("who")))
    return (
        held.select("value", F.explode(who).alias("x")).groupBy("value", "x.of_owner", "x.who").agg(F.count("*").alias("n"))
        .groupBy("value").agg(
            F.count(F.when(F.col("of_owner"), F.col("who"))).alias("n_owners"), F.count(F.when(~F.col("of_owner"), F.col("who"))).alias("n_repositories"), F.sum(F.when(F.col("of_owner"), F.col("n"))).alias("n"))
    )


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, h, found: array of (start, kind, end, live, n_owners, n_repositories) by start, then kind. One row for each input row.

    found holds all base spans, and the added kinds' spans whose value looks live.
    """
    found = materialize(candidates(clean_of(docs, *dict.fromkeys(("doc_id", "text", owner, repository))), owner, repository), "candidates")
    owned = materialize(ownership(found), "ownership")
    spread = materialize(found.where(F.size("spans") > 0).select("doc_id", "h", F.explode("spans").alias("s")).select("doc_id", "h", "s.*").distinct(), "spans")
    judged = spread_join(spread, owned, "value", "n", spread.count())
    judged = judged.withColumn("live", (F.col("n_owners") <= max_owners) & ~((F.col("n_owners") > 1) & (F.col("n_repositories") > max_repositories)))
    judged = judged.where(F.col("live") | (F.col("kind") < len(BASE)))
    per_doc = judged.groupBy(F.col("doc_id").alias("of_doc"), F.col("h").alias("of_h")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live", "n_owners", "n_repositories"))).alias("found"))
    rows = found.select("doc_id", "h").join(per_doc, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("h") == F.col("of_h")), "left")
    return rows.select("doc_id", "h", F.coalesce("found", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,live:boolean,n_owners:bigint,n_repositories:bigint>>)")).alias("found"))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


#: Code points that are cut out at a time.
STRIP = 4096


def marked_out(text: Column, spans: Column, mark: str) -> Column:
    """text with the union of the spans (by start) replaced by a mark for each span that begins outside those before.

    The text is cut into strips first, as finding a place costs in proportion to its distance from the start.
    """
    strips = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % STRIP), F.lit(0))

    def cut(s, a, b):
        """Code points a to b."""
        part = lambda k: F.substring(F.get(s, k), (F.greatest(a - k * STRIP, F.lit(0)) + 1).cast("int"), (F.least(b - k * STRIP, F.lit(STRIP)) - F.greatest(a - k * STRIP, F.lit(0))).cast("int"))
        return F.when(a < b, F.array_join(F.transform(F.sequence(F.floor(a / STRIP).cast("int"), F.floor((b - 1) / STRIP).cast("int")), part), "")).otherwise("")

    def built(x):
        s, e, until = x["s"], x["e"], x["until"]
        before = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(until, i - 1))
        pieces = F.transform(e, lambda y, i: F.when(y["start"] >= before(i), F.concat(cut(s, before(i), y["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), cut(s, F.element_at(until, -1), F.length(text).cast("bigint")))

    until = running_array(F.transform(spans, lambda y: y["end"]), F.lit(0).cast("bigint"), lambda a, y: F.greatest(a, y))
    return let(F.struct(strips.alias("s"), spans.alias("e"), until.alias("until")), built)


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", mark: str = "[SECRET]", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """docs with the live-looking spans of text replaced by a mark; overlapping spans count as one. Other columns stay.

    Texts without such spans aren't shuffled, however many there are with them.
    """
    live = scan(docs, owner, repository, max_owners, max_repositories).select(F.col("doc_id").alias("of_doc"), F.col("h").alias("of_h"), F.transform(F.filter("found", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("live"))
    live = materialize(live.where(F.size("live") > 0).distinct(), "live")
    rows = docs.select(packed(docs), F.col("doc_id").alias("own_doc"), "text", text_key(F.col("text")).alias("own_h"))
    n, n_spans = live.agg(F.count("*"), F.sum(F.size("live"))).first()
    same = F.col("own_doc").eqNullSafe(F.col("of_doc")) & (F.col("own_h") == F.col("of_h"))
    joined = meet(rows, live, same, "left", n if (n_spans or 0) <= 1_000_000 else 1 << 62, F.xxhash64("own_doc", "own_h"), F.xxhash64("of_doc", "of_h"), 1 << 61)
    clean = F.when(F.col("live").isNotNull(), marked_out(F.col("text"), F.col("live"), mark)).otherwise(F.col("text"))
    return joined.select(*[(clean if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of the op5 query, n_live, and the largest counts of owners and repositories of the document's values."""
    base = F.filter("found", lambda s: s["kind"] < len(BASE))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    most = [F.coalesce(F.array_max(F.col(f"found.{c}")), F.lit(0)).cast("long").alias(c) for c in ("n_owners", "n_repositories")]
    return scan(docs).select("doc_id", *[count(k) for k in BASE], F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("found")).alias("spans"), F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"), *most)
