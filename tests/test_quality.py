"""Validators: each rule is broken once, and the counters are held against sets."""

import pytest
from pyspark.sql import functions as F

from reactrix.operators import quality as Q

META = ["source_type", "word_count", "content_length_bucket", "strata_label", "sampling_method", "candidate_label", "candidate_reason"]
PLAN = Q.Plan(20, META, ["note"], ["News"], ["Long"], (({"A_Random_Baseline": 4}, {1}), ({"A_Random_Baseline": 12}, {1})), n_labels=2, first=6, tolerance=1)


def good(spark):
    """60 rows of two pages; a pilot of 16 baseline rows and two of each of two labels; phases of 6 and 14."""
    base = spark.range(60).select(F.col("id").alias("record_id"), F.concat(F.lit("page"), F.col("id") % 2).alias("page_name"), F.lit("News").alias("source_type"), F.lit(9).alias("word_count"), F.lit("Long").alias("content_length_bucket"))
    i = F.col("record_id")
    covered = i.isin(16, 17, 18, 19)
    pilot = base.where("record_id < 20").select("*", F.when(covered, "B_Candidate_Coverage").otherwise("A_Random_Baseline").alias("strata_label"), F.lit("m").alias("sampling_method"), F.when(covered, F.concat(F.lit("T"), i % 2)).otherwise("none").alias("candidate_label"),
                                                F.lit("r").alias("candidate_reason"), F.lit("").alias("note"), F.when((i < 4) | i.isin(16, 17), "Phase_1").otherwise("Phase_2").alias("pilot_phase"))
    phases = [pilot.where(F.col("pilot_phase") == f"Phase_{k}") for k in (1, 2)]
    return {"original": base, "pilot": pilot, "pool": base.where("record_id >= 20"), "ids": pilot.select("record_id"), "phases": phases, "phase_ids": [p.select("record_id") for p in phases]}


def failed(spark, **changed):
    rows = Q.sampling_checks(**(good(spark) | changed), plan=PLAN).collect()
    assert len(rows) == 14
    return {r.check: r for r in rows if not r.passed}


def test_a_good_pilot_passes_all_fourteen(spark):
    assert failed(spark) == {}


def breaks(g, spark):
    i, null = F.col("record_id"), F.lit(None)
    one = g["pilot"].where("record_id = 3")
    return {
        "size": ({"pilot": g["pilot"].where("record_id < 18")}, 18, ""),
        "conservation": ({"pool": g["pool"].where("record_id <> 30")}, -1, ""),
        "no_duplicates": ({"pilot": g["pilot"].unionByName(one).unionByName(one)}, 2, "3, 3"),
        "no_leakage": ({"pool": g["pool"].unionByName(g["original"].where("record_id in (3, 5)"))}, 2, "3, 5"),
        "all_accounted_for": ({"pool": g["pool"].withColumn("record_id", F.when(i == 30, 99).otherwise(i))}, 2, "30, 99"),
        "strata_not_null": ({"pilot": g["pilot"].withColumn("strata_label", F.when(i != 7, F.col("strata_label")))}, 1, "7"),
        "strata_disjoint": ({"pilot": g["pilot"].unionByName(one.withColumn("strata_label", F.lit("C")))}, 1, "3"),
        "page_coverage": ({"original": g["original"].withColumn("page_name", F.when(i == 40, "lost").otherwise(F.col("page_name")))}, 1, "lost"),
        "metadata": ({"pilot": g["pilot"].withColumns({"source_type": F.when(i == 2, "Blog").otherwise(F.col("source_type")), "word_count": F.when(i != 4, F.col("word_count"))}).drop("candidate_reason")}, 3, "candidate_reason, source_type of 2, word_count of 4"),
        "scaffold_present": ({"pilot": g["pilot"].drop("note")}, 1, "note"),
        "scaffold_absent": ({"pool": g["pool"].withColumn("note", F.lit(""))}, 1, "note"),
        "ids_match": ({"ids": g["ids"].where("record_id <> 5").unionByName(spark.range(70, 71).toDF("record_id"))}, 2, "5, 70"),
        "no_null_ids": ({"pool": g["pool"].withColumn("record_id", F.when(i == 30, null).otherwise(i))}, 1, "pool"),
        "phases": ({"phases": [g["phases"][0], g["phases"][1].where("record_id <> 9")]}, 4, "ids of phase 2, phases aren't the pilot, size of phase 2, strata of phase 2"),
    }


@pytest.mark.parametrize("rule", ["size", "conservation", "no_duplicates", "no_leakage", "all_accounted_for", "strata_not_null", "strata_disjoint", "page_coverage", "metadata", "scaffold_present", "scaffold_absent", "ids_match", "no_null_ids", "phases"])
def test_every_rule_can_break(spark, rule):
    changed, observed, sample = breaks(good(spark), spark)[rule]
    found = failed(spark, **changed)
    assert rule in found and (found[rule].observed, found[rule].sample) == (observed, sample)


def test_digests_add_up(spark):
    whole = spark.range(1000).toDF("id")
    parts = [whole.where("id % 3 = 0"), whole.where("id % 3 > 0")]
    assert Q.together(*[Q.digest(p, "id") for p in parts]) == Q.digest(whole, "id")
    assert Q.digest(whole.where("id <> 5").union(whole.where("id = 6")), "id") != Q.digest(whole, "id")
    assert Q.differing(parts, [whole], "id").isEmpty()
    assert sorted(r.id for r in Q.differing([whole.where("id < 990")], [whole.where("id > 2")], "id").collect()) == [0, 1, 2, *range(990, 1000)]


def test_scenario_counters(spark):
    rows = [
        ("train", "1", "a text", "T01"), ("train", " 2 ", "b", "T02"), ("train", "2", "b", "T02"), ("train", "3", "c", "T01"), ("train", "3", "c!", "T01"), ("train", None, "d", "T01"), ("train", "4", " ", "T02"), ("train", "5", None, None),
        ("val", "1", "v", "T18"), ("val", "6", "a text ", "T99"), ("val", "7", "w", ""), ("test", "8", "x", "T01"), ("test", "9", "y", "T02"), ("test", "6", "z", "T01"), ("test", "4", "q", "T01")]
    df = spark.createDataFrame(rows, "split string, record_id string, text string, label string")
    raw = spark.createDataFrame([("8",), ("9",), ("10",)], "record_id string")
    got = {(r.check, r.split): r.observed for r in Q.scenario_checks(df, raw, ["T01", "T02"], "T18").collect()}
    want = {
        ("rows", "train"): 8, ("rows", "val"): 3, ("rows", "test"): 4, ("null_id", "train"): 1, ("null_text", "train"): 1, ("empty_text", "train"): 2, ("null_label", "train"): 1, ("null_label", "val"): 1, ("removed_label", "val"): 1,
        ("invalid_label", "val"): 1, ("duplicate_id", "train"): 2, ("conflicting_duplicates", "train"): 1, ("missing_classes", "train"): 0, ("missing_classes", "val"): 2, ("balanced", "test"): 2,
        ("id_overlap_train_val", "all"): 1, ("id_overlap_train_test", "all"): 0, ("id_overlap_val_test", "all"): 1, ("text_overlap_train_val", "all"): 1, ("missing_from_test", "all"): 1, ("extra_in_test", "all"): 2}
    assert {k: got[k] for k in want} == want


def test_result_matrix(spark):
    rows = [(s, m, "success", 0.5) for s in "ab" for m in "xy"]
    keys = {"s": ["a", "b"], "m": ["x", "y"]}
    check = lambda data: {r.check: r.observed for r in Q.matrix_checks(spark.createDataFrame(data, "s string, m string, status string, f1 double"), keys, ["f1"]).collect() if not r.passed}
    assert check(rows) == {}
    assert check([*rows[1:], ("a", "y", "failed", None), ("c", "x", "success", 0.1)]) == {"rows": 5, "missing": 1, "unexpected": 1, "repeated": 1, "failed": 1, "null_metric": 1}
