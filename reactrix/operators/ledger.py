"""A durable table of trials: a run that was killed goes on where it ended, and failed finals are fitted anew from it.

A trial's key is a digest of its scenario, model and settings. Each finished trial is one idempotent write under its key in a shared folder; what a list of
candidates still lacks is an anti-join by key.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import exists
from .learning import FAILURES, Features, fit, measured, weighted
from .ranking import best_in_group

SCHEMA = ("key string, scenario string, model_name string, params string, stage string, status string, note string, macro_f1_val double, weighted_f1_val double, accuracy_val double, train_time_sec double")


def trial_key(scenario: str, model: str, params: dict, stage: str = "trial") -> str:
    return hashlib.sha256(json.dumps([stage, scenario, model, params], sort_keys=True, default=str).encode()).hexdigest()


class Ledger:
    """The trials of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, **row) -> None:
        """Writes one finished trial; written again, it replaces itself."""
        one = self.spark.createDataFrame([tuple(row.get(c.split()[0]) for c in SCHEMA.split(", "))], SCHEMA)
        one.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{row['key']}")

    def read(self) -> DataFrame:
        """All finished trials. A write that was cut short has left no row."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def pending(self, candidates: list[tuple[str, str, dict]], stage: str = "trial") -> list[tuple[str, str, dict]]:
        """Candidates (scenario, model, settings) that have no row yet, in their order."""
        by_key = {trial_key(*c, stage): c for c in candidates}
        asked = self.spark.createDataFrame([(k,) for k in by_key], "key string")
        left = {r.key for r in asked.join(self.read().select("key"), "key", "left_anti").collect()}  # at most the candidates
        return [c for k, c in by_key.items() if k in left]


def run(ledger: Ledger, splits: dict[str, tuple[DataFrame, DataFrame]], candidates: list[tuple[str, str, dict]], labels: list[str], stage: str = "trial", note: str = "", most: int | None = None, made: dict[str, Features] | None = None) -> DataFrame:
    """Fits what the ledger lacks of the candidates, on each scenario's (train, validation) rows, and gives the ledger's table. most: no more than so many now.
    made: the scenarios' features so far, which this run uses and adds to."""
    made = {} if made is None else made
    for scenario, model, params in ledger.pending(candidates, stage)[:most]:
        train, val = splits[scenario]
        row = {"key": trial_key(scenario, model, params, stage), "scenario": scenario, "model_name": model, "params": json.dumps(params, sort_keys=True, default=str), "stage": stage}
        began = time.time()
        try:
            if scenario not in made:
                made[scenario] = Features(weighted(train), val)
            fitted, told = fit(model, train, val, made[scenario], **params)
            m = measured(fitted, made[scenario], labels)
            row |= {"status": "success", "note": "; ".join(x for x in (note, told) if x), "macro_f1_val": float(m.macro_f1), "weighted_f1_val": float(m.weighted_f1), "accuracy_val": float(m.accuracy)}
        except FAILURES as e:
            row |= {"status": "failed", "note": f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"}
        ledger.append(**row, train_time_sec=time.time() - began)
    return ledger.read()


def repair(ledger: Ledger, splits: dict[str, tuple[DataFrame, DataFrame]], labels: list[str], made: dict[str, Features] | None = None) -> DataFrame:
    """Fits each failed final anew with the best successful trial of its scenario and model, and gives the finals: the repaired row where there is one, else the first."""
    made = {} if made is None else made
    table = ledger.read()
    best = best_in_group(table.where("stage = 'trial' and status = 'success'"), ["scenario", "model_name"], F.col("macro_f1_val").desc_nulls_last(), F.col("weighted_f1_val").desc_nulls_last(), F.col("accuracy_val").desc_nulls_last(), F.col("key"))
    failed = table.where("stage = 'final' and status <> 'success'").select("scenario", "model_name").distinct()
    todo = failed.join(best.select("scenario", "model_name", "params", F.col("key").alias("from_trial")), ["scenario", "model_name"]).orderBy("scenario", "model_name").collect()  # one row for each final
    for r in todo:
        run(ledger, splits, [(r.scenario, r.model_name, json.loads(r.params))], labels, "repair", f"repaired from trial {r.from_trial[:12]}", made=made)
    finals = ledger.read().where("stage in ('final', 'repair')")
    order = F.when((F.col("stage") == "repair") & (F.col("status") == "success"), 0).otherwise(1)
    return best_in_group(finals.withColumn("order", order), ["scenario", "model_name"], F.col("order"), F.col("key")).drop("order")
