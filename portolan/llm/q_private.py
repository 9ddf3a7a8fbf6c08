"""Queries of the operators that look for personal data and secrets."""

from __future__ import annotations

from portolan.llm import pii, secret_scan
from portolan.llm.common import read
from portolan.llm.queries import query


@query("op2_personal_data", pii.sql())
def personal_data_query(spark, d):
    return pii.digest(pii.personal_spans(read(spark, d, "documents")))


@query("op3_secret_scan", secret_scan.sql())
def secret_scan_query(spark, d):
    return secret_scan.scan(read(spark, d, "documents"))
