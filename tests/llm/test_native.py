"""Native operators stay in the JVM: neither their results nor the tables they write on the way run Python."""

import re

import pytest

from reactrix.llm import decontam, merkle, mixing, pii, quality_rules, secrets

from .cases import awkward, frame


def items(spark):
    return spark.createDataFrame([(1, "one two three"), (2, "same line here")], "item_id bigint, text string")


@pytest.mark.parametrize("run", [
    lambda s, d: decontam.digest(d, items(s)), lambda s, d: secrets.digest(d), lambda s, d: secrets.redact(d), lambda s, d: quality_rules.digest(d), lambda s, d: pii.pseudonymize(d, "k"), lambda s, d: mixing.digest(d), lambda s, d: mixing.attach(d), lambda s, d: merkle.digest(d)])
def test_no_python(spark, tmp_path, monkeypatch, run):
    path = str(tmp_path / "docs")
    frame(spark, awkward()).write.parquet(path)
    plans = []
    for module in (decontam, secrets, mixing, merkle):
        write = module.materialize

        def kept(df, name, write=write):
            plans.append(df._jdf.queryExecution().toString())
            return write(df, name)

        monkeypatch.setattr(module, "materialize", kept)
    plans.append(run(spark, spark.read.parquet(path))._jdf.queryExecution().toString())
    assert not [x for p in plans for x in re.findall(r"\w*(?:Python|Pandas|Arrow|ExternalRDD)\w*", p)]
