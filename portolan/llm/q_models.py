"""Queries of the operators that learn a model."""

from __future__ import annotations

from portolan.llm import byte_cnn, lang_bloom, toxicity
from portolan.llm.common import read
from portolan.llm.queries import query


@query("op8_byte_cnn")
def byte_cnn_query(spark, d):
    return byte_cnn.classify(read(spark, d, "documents"), read(spark, d, "labels"))


@query("op5_toxicity_chain")
def toxicity_query(spark, d):
    return toxicity.toxic_rows(read(spark, d, "documents"), read(spark, d, "labels"))


@query("op9_language_bloom")
def language_query(spark, d):
    return lang_bloom.identify(read(spark, d, "documents").select("doc_id", "text", "lang"))
