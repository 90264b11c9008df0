"""Registered queries of the training-data operators. Each reads its whole tables and applies one operator."""

from __future__ import annotations

import public_tokenizers

from . import decontam, langid, linear, lm, merkle, mixing, pieces, pii, quality_rules, secrets, simhash, whitening
from .common import table
from .oracles import ORACLES

#: Setting that holds the key of the PII query's pseudonyms; its name is one that Spark hides. Plans show the key, too, unless
#: spark.sql.redaction.string.regex matches it. The default is for demonstration only.
PII_KEY, DEMO_KEY = "spark.reactrix.pii.secret", "reactrix-demo-key"
#: The SentencePiece model of the encoding query.
PIECES = "piece_bpe_32k.model"


def op1_simhash(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark, sf_dir):
    return linear.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark, sf_dir):
    return linear.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark, sf_dir):
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark, sf_dir):
    return langid.language(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.pseudonymize(table(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, DEMO_KEY))


def op10_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_merkle(spark, sf_dir):
    return merkle.digest(table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark, sf_dir):
    return pieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontamination, op3_toxicity, op4_quality, op5_secrets, op6_lm_scoring, op7_language, op8_quality_rules, op9_pii, op10_mixing, op11_whitening, op12_merkle, op13_sentencepiece)}
