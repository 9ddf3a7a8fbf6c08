"""Queries against their SQL twins on the smallest tables.

A part of them by default; all with PORTOLAN_ALL=1. tools/check_oracles.py does the
same at any scale.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, table_of

SF = "/root/testdata/sf0.001"
SOME = (
    "k5_carriers_at_port", "j7_movements", "f1_filter_set", "f17_year_values", "c1_normalize_text", "c4_parse_quantity", "c15_detect_schema",
    "a2_container_total_by", "a3_kpi_block", "a14_describe", "a15_column_profile", "w12_period_comparisons", "w15_forecast", "g2_upsell",
    "g9_commercial_insights", "b1_set_goals", "x2_summary_documents", "x6_keyword_search_many", "x11_hybrid_search", "n6_filters",
    "t2_check_for_updates", "t6_rate_limit", "t7_window_kpis_stream", "t3_incremental_refresh", "t8_audit_stream", "s1_read_by_extension",
    "s11_chat_files", "s13_snapshots", "l16_download_links",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PORTOLAN_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    frame = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert table_of(frame.columns, rows) == table_of(columns, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
