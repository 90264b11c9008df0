"""The training-data queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from reactrix.llm import queries

from ..test_oracles import DATA, TABLES, table

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.ORACLES[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in want.description], want.fetchall())


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from reactrix.llm import common

    class Nothing:
        def __getattr__(self, name):
            return self

        def __call__(self, *_):
            return self

        def get(self, *_):
            return None

        def isDefined(self):
            return False

    spark = Nothing()
    spark.master = "spark://host:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(spark)
