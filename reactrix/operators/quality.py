"""Data checks as one table: check, passed, observed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, **rules: tuple[Column, Column]) -> DataFrame:
    """rules: name -> (observed aggregate, condition on the column ``observed``). One pass over df for all of them."""
    row = df.agg(*[v.cast("bigint").alias(k) for k, (v, _) in rules.items()])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("observed")) for k in rules])).alias("x")).select("x.*")
    passed = reduce(lambda rest, k: F.when(F.col("check") == k, rules[k][1]).otherwise(rest), rules, F.lit(False))
    return long.select("check", passed.alias("passed"), "observed")


def same_ids(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """n_only_a, n_only_b: both 0 for equal sets."""
    sides = a.select(id_col, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(id_col, F.lit(0).alias("a"), F.lit(1).alias("b")))
    met = sides.groupBy(id_col).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return met.agg(F.count_if(F.col("a") > F.col("b")).alias("n_only_a"), F.count_if(F.col("b") > F.col("a")).alias("n_only_b"))


def digest(df: DataFrame, id_col: str) -> tuple:
    """A multiset's fingerprint: rows, and of two hashes of the ids a sum and an exclusive or. Those of parts add up to that of the whole (see together())."""
    h = F.xxhash64(F.col(id_col).cast("string"))
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(F.xxhash64(F.lit("other"), F.col(id_col).cast("string"))), F.lit(0)).alias("x")).first()
    return row.n, int(row.s), row.x


def together(*digests: tuple) -> tuple:
    n, s, x = 0, 0, 0
    for d in digests:
        n, s, x = n + d[0], s + d[1], x ^ d[2]
    return n, s, x


def differing(left: list[DataFrame], right: list[DataFrame], id_col: str) -> DataFrame:
    """id of what is on one side only, once each. Sides that are equal as multisets are told by their digests, without a shuffle."""
    kind = left[0].select(id_col)
    if together(*[digest(d, id_col) for d in left]) == together(*[digest(d, id_col) for d in right]):
        return kind.limit(0).toDF("id")
    sides = None
    for bit, frames in ((1, left), (2, right)):
        for d in frames:
            own = d.select(F.col(id_col).alias("id"), F.lit(bit).alias("bit"))
            sides = own if sides is None else sides.unionByName(own)
    return sides.groupBy("id").agg(F.bit_or("bit").alias("mask")).where("mask <> 3").select("id")


def violations(df: DataFrame, **rules: DataFrame) -> DataFrame:
    """check, passed, observed, sample: how many rows each rule's table has (what breaks the rule, in one column), and the first five of them. df gives the session."""
    out = None
    for name, found in rules.items():
        bad = found.toDF("id").select(F.col("id").cast("string").alias("id"))
        count = bad.agg(F.count("*").alias("observed")).select(F.lit(name).alias("check"), "observed", F.lit("").alias("sample"))
        five = bad.orderBy("id").limit(5).agg(F.sort_array(F.collect_list("id")).alias("ids"))
        row = count.unionByName(five.select(F.lit(name).alias("check"), F.lit(0).cast("bigint").alias("observed"), F.array_join("ids", ", ").alias("sample")))
        out = row if out is None else out.unionByName(row)
    met = out.groupBy("check").agg(F.max("observed").alias("observed"), F.max("sample").alias("sample"))
    return met.select("check", (F.col("observed") == 0).alias("passed"), "observed", "sample")


@dataclass
class Plan:
    """What a pilot has to be like. phases: of the first and second phase, rows by stratum and rows of each covered label."""

    expected: int
    metadata: list[str]
    scaffold: list[str]
    source_types: list[str]
    buckets: list[str]
    phases: tuple
    n_labels: int = 18
    first: int = 100
    tolerance: int = 10


def sampling_checks(original: DataFrame, pilot: DataFrame, pool: DataFrame, ids: DataFrame, phases: list[DataFrame], phase_ids: list[DataFrame], plan: Plan, id_col: str = "record_id", page: str = "page_name") -> DataFrame:
    """Fourteen rules over a pilot, its pool, the list of its ids and its two phases: check, passed, observed, sample (of what breaks the rule)."""
    spark = original.sparkSession
    lit = lambda values: spark.createDataFrame([(v,) for v in values], "id string")
    n_original, n_pilot, n_pool = original.count(), pilot.count(), pool.count()

    def repeated(df):
        return df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col, F.explode(F.sequence(F.lit(2), F.col("n")))).select(id_col)

    both = pool.select(id_col).join(pilot.select(id_col), id_col, "left_semi").distinct()
    pages = original.where(F.col(page).isNotNull()).select(page).distinct().join(pilot.select(page), page, "left_anti")
    metadata = lit([c for c in plan.metadata if c not in pilot.columns])
    for c in [c for c in plan.metadata if c in pilot.columns]:
        bad = F.col(c).isNull()
        if c in ("source_type", "content_length_bucket"):
            bad = bad | ~F.col(c).isin(plan.source_types if c == "source_type" else plan.buckets)
        metadata = metadata.unionByName(pilot.where(bad).select(F.concat(F.lit(f"{c} of "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("id")))
    nulls = lit([])
    for name, df in (("original", original), ("pilot", pilot), ("pool", pool)):
        nulls = nulls.unionByName(df.where(F.col(id_col).isNull()).select(F.lit(name).alias("id")))
    strata = pilot.groupBy(id_col).agg(F.count_distinct("strata_label").alias("n")).where("n > 1").select(id_col)

    def odd(df, by_stratum, by_label):
        """Whether the rows of strata, or of covered labels, aren't as planned."""
        n = {r.strata_label: r["count"] for r in df.groupBy("strata_label").count().collect()}
        own = [r["count"] for r in df.where("strata_label = 'B_Candidate_Coverage'").groupBy("candidate_label").count().collect()]
        return any(n.get(s, 0) != k for s, k in by_stratum.items()), len(own) != plan.n_labels or any(k not in by_label for k in own)

    first, second = phases
    broken = {"size of phase 1": first.count() != plan.first, "size of phase 2": second.count() != n_pilot - plan.first}
    broken["phases overlap"] = not first.join(second, id_col, "left_semi").isEmpty()
    broken["phases aren't the pilot"] = not differing(phases, [pilot], id_col).isEmpty()
    for k, (df, own, (by_stratum, by_label)) in enumerate(zip(phases, phase_ids, plan.phases, strict=True), 1):
        broken[f"ids of phase {k}"] = not differing([df], [own], id_col).isEmpty()
        broken[f"strata of phase {k}"], broken[f"labels of phase {k}"] = odd(df, by_stratum, by_label)
        broken[f"name of phase {k}"] = "pilot_phase" not in df.columns or not df.where(~F.col("pilot_phase").eqNullSafe(F.lit(f"Phase_{k}"))).isEmpty()
    table = violations(
        original, no_duplicates=repeated(pilot), no_leakage=both, all_accounted_for=differing([pilot, pool], [original], id_col), strata_not_null=pilot.where("strata_label is null").select(id_col), strata_disjoint=strata,
        page_coverage=pages, metadata=metadata, scaffold_present=lit([c for c in plan.scaffold if c not in pilot.columns]), scaffold_absent=lit([c for c in plan.scaffold if c in pool.columns]),
        ids_match=differing([pilot], [ids], id_col), no_null_ids=nulls, phases=lit([k for k, bad in broken.items() if bad]))
    sizes = spark.createDataFrame([("size", abs(n_pilot - plan.expected) <= plan.tolerance, n_pilot, ""), ("conservation", n_pilot + n_pool == n_original, n_pilot + n_pool - n_original, "")], table.schema)
    return sizes.unionByName(table)


SPLIT_BITS = {"train": 1, "val": 2, "test": 4}
RAW_TEST = 8


def scenario_checks(rows: DataFrame, raw_test: DataFrame, labels: list[str], removed: str) -> DataFrame:
    """check, split, passed, observed of a scenario's splits. rows: split, record_id, text, label; raw_test: record_id of the reference's test split.

    One shuffle gives each id the bits of the splits that have it, one each digest of a text; overlaps, the ids that are missing from the test split or extra there, and leaked texts
    are counts of masks. An id is in conflict where a split has it with several labels or texts. Ids and labels are stripped of blanks; empty ones are null, as empty texts are left out of masks. The first
    of a split's duplicates isn't counted as one. ``balanced`` is the difference between the largest and smallest label, passed up to 1.
    """
    strip = lambda c: F.nullif(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", ""), F.lit(""))
    text = strip("text")
    base = rows.select("split", strip("record_id").alias("id"), strip("label").alias("label"), F.col("text").isNull().alias("no_text"), F.md5(text).alias("key"))
    bit = F.lit(None).cast("int")
    for s, b in SPLIT_BITS.items():
        bit = F.when(F.col("split") == s, b).otherwise(bit)
    kept = base.withColumn("bit", bit)
    by_split = base.groupBy("split").agg(
        F.count("*").alias("rows"), F.count_if(F.col("id").isNull()).alias("null_id"), F.count_if("no_text").alias("null_text"), F.count_if(F.col("key").isNull()).alias("empty_text"), F.count_if(F.col("label").isNull()).alias("null_label"),
        F.count_if(F.col("label") == removed).alias("removed_label"), F.count_if(~F.col("label").isin([*labels, removed])).alias("invalid_label"))
    names = [c for c in by_split.columns if c != "split"]
    counters = by_split.unpivot("split", names, "check", "observed")
    of_id = kept.groupBy("split", "bit", "id").agg(F.count("*").alias("n"), F.count_if(F.col("key").isNotNull()).alias("n_text"), (F.greatest(F.count_distinct("label"), F.count_distinct(F.coalesce("key", F.lit("")))) > 1).alias("conflict"))
    twice = of_id.groupBy("split").agg(F.sum(F.col("n") - 1).alias("duplicate_id"), F.count_if(F.col("conflict") & (F.col("n") > 1)).alias("conflicting_duplicates")).unpivot("split", ["duplicate_id", "conflicting_duplicates"], "check", "observed")
    marks = of_id.where("n_text > 0 and id is not null").select("id", "bit").unionByName(raw_test.select(strip("record_id").alias("id"), F.lit(RAW_TEST).alias("bit")).where("id is not null"))
    ids = marks.groupBy("id").agg(F.bit_or("bit").alias("mask"))
    texts = kept.where("key is not null").groupBy("key").agg(F.bit_or("bit").alias("mask"))
    has = lambda m: F.col("mask").bitwiseAND(F.lit(m)) == m
    pairs = {"train_val": 3, "train_test": 5, "val_test": 6}
    one = ids.agg(*[F.count_if(has(m)).alias(f"id_overlap_{p}") for p, m in pairs.items()], F.count_if(has(8) & ~has(4)).alias("missing_from_test"), F.count_if(has(4) & ~has(8)).alias("extra_in_test"))
    two = texts.agg(*[F.count_if(has(m)).alias(f"text_overlap_{p}") for p, m in pairs.items()])
    whole = [d.unpivot([], d.columns, "check", "observed").withColumn("split", F.lit("all")) for d in (one, two)]
    counts = base.where(F.col("key").isNotNull() & F.col("label").isNotNull()).groupBy("split", "label").agg(F.count("*").alias("n"))
    classes = counts.groupBy("split").agg((F.lit(len(labels)) - F.count_if(F.col("label").isin(labels))).cast("bigint").alias("missing_classes"), (F.max("n") - F.min("n")).alias("balanced")).unpivot("split", ["missing_classes", "balanced"], "check", "observed")
    out = counters.unionByName(twice).unionByName(classes)
    for d in whole:
        out = out.unionByName(d)
    told = F.col("check").isin("rows", "balanced")
    return out.select("check", "split", F.when(~told, F.col("observed") == 0).when(F.col("check") == "rows", F.col("observed") > 0).otherwise(F.col("observed") <= 1).alias("passed"), F.col("observed").cast("bigint").alias("observed"))


def matrix_checks(results: DataFrame, keys: dict[str, list], metrics: list[str]) -> DataFrame:
    """check, passed, observed of a result table that should have one successful row, without null metrics, for each combination of the keys."""
    grid = results.sparkSession.range(1).select()
    for k, values in keys.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(k))
    null = F.lit(False)
    for m in metrics:
        null = null | F.col(m).isNull()
    own = results.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("status") != "success").alias("failed"), F.count_if(null).alias("null_metric"))
    met = grid.withColumn("expected", F.lit(1)).join(own, list(keys), "full_outer")
    zero, o = F.col("observed") == 0, F.col("observed")
    wanted = 1
    for values in keys.values():
        wanted *= len(values)
    return checks(
        met, rows=(F.sum(F.coalesce("n", F.lit(0))), o == wanted), missing=(F.count_if(F.col("n").isNull()), zero), unexpected=(F.coalesce(F.sum(F.when(F.col("expected").isNull(), F.col("n"))), F.lit(0)), zero),
        repeated=(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)), zero), failed=(F.coalesce(F.sum("failed"), F.lit(0)), zero), null_metric=(F.coalesce(F.sum("null_metric"), F.lit(0)), zero))
