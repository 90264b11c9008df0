"""Every registered query against its DuckDB SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from reactrix.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return None if isinstance(v, float) and math.isnan(v) else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted([tuple(plain(r[k]) for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.ORACLES[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_trials_of_every_family_succeed(spark):
    rows = registry.QUERIES["l2_l4_trials"](spark, DATA).collect()
    assert {r.model_name for r in rows} == {"LogisticRegression", "LinearSVC", "RandomForest", "GradientBoosting"} and {r.status for r in rows} == {"success"}
    assert all(r.macro_f1_val > 0.5 for r in rows if r.model_name != "GradientBoosting")


def test_manifest_and_samplers(spark):
    files = registry.QUERIES["s16_manifest"](spark, DATA).where("kind = 'parquet'").collect()
    assert files and all(r.bytes > 0 and r.path.endswith(".parquet") for r in files)
    for name in ("p2_round_robin", "p3_greedy_labels"):
        ids = [r.record_id for r in registry.QUERIES[name](spark, DATA).collect()]
        assert ids and len(ids) == len(set(ids)), f"{name}: no row is taken twice"


def test_final_predictions_are_right_on_held_out_rows(spark):
    rows = registry.QUERIES["l5_l6_l9_final_predictions"](spark, DATA).collect()
    assert rows and sum(r.y_true == r.y_pred for r in rows) > 0.8 * len(rows)
