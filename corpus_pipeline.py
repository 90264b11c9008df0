"""A training corpus from raw documents, by five of the operators of reactrix.llm in sequence.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents; the last one
adds the mix. run() writes each stage's result as Parquet in the shared folder and reads it for the next; what a stage wrote on the way goes when it ends.

In all stages null or empty texts are documents without words, very long texts are read whole, repeated rows are decided alike (near_duplicates keeps
one of them), extra columns stay, and an empty table gives an empty table. Classifiers, language models, language identification and pseudonyms are
left out: they label or rewrite texts, and what to drop by them is the user's choice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from reactrix.llm import decontam, mixing, quality_rules, secrets, simhash
from reactrix.llm.common import drop_table, materialize, meet, packed, table, temporary, text_key


def quality(spark, docs, sf_dir):
    """Drops what the quality policy rejects, null, empty and blank texts among them. No rule depends on another row, so there are no ties."""
    return quality_rules.apply_policy(quality_rules.ledger(docs, whole=True)).where("kept").select("row.*")


def near_duplicates(spark, docs, sf_dir):
    """Keeps one row of each near-duplicate group: that of the least doc_id, null last; of repeated rows and other ties that which stands first in the files.

    Rows are told apart by their place in the files, which holds however often a task is run. Texts of rows that stay are hardly shuffled (see meet()).
    """
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place.getField("row_index"))
    except AnalysisException:  # not read from files
        docs = materialize(docs, "documents")
        place = docs.metadataColumn("_metadata")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.xxhash64(place.getField("file_path")).alias("file"), place.getField("row_index").alias("line"))
    rows = docs.select(packed(docs), place.alias("place"), "text")
    groups = simhash.near_duplicates(rows.select("place", "text"), order="place")
    dropped = materialize(groups.where("place <> component_id").select(F.col("place.file").alias("of_file"), F.col("place.line").alias("of_line")), "dropped")
    same = (F.col("place.file") == F.col("of_file")) & (F.col("place.line") == F.col("of_line"))
    return meet(rows.drop("text"), dropped, same, "left_anti", dropped.count(), F.xxhash64("place.file", "place.line"), F.xxhash64("of_file", "of_line")).select("row.*")


def decontamination(spark, docs, sf_dir):
    """Drops documents that the benchmark contaminates; a document is known by its doc_id (null too) and text, so rows that share but one of them are told apart."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    found = materialize(found.select(F.col("doc_id").alias("of_doc"), F.col("h").alias("of_h")).distinct(), "contaminated")
    rows = docs.select(packed(docs), F.col("doc_id").alias("own_doc"), text_key(F.col("text")).alias("own_h"))
    same = F.col("own_doc").eqNullSafe(F.col("of_doc")) & (F.col("own_h") == F.col("of_h"))
    return meet(rows, found, same, "left_anti", found.count(), F.xxhash64("own_doc", "own_h"), F.xxhash64("of_doc", "of_h")).select("row.*")


def secret_redaction(spark, docs, sf_dir):
    """Replaces live-looking secrets in the texts, overlapping ones by one mark; no document goes. n_chars, where there is one, is counted anew."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark, docs, sf_dir):
    """Documents that the mix takes words of, with size, source_size, target and taken. Of rows alike at a source's edge each takes the same part."""
    return mixing.attach(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_redaction),
    ("mixing", mixture),
]


def run(spark, sf_dir):
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        if last is not None:
            drop_table(last)
        last = docs
    return docs


ORACLE_SQL = None
