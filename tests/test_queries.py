"""Registered queries against the DuckDB oracle on the smallest driver tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from churnkit.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.001"
FAST = ["SRC1_members_left", "SRC2_members_mixed", "U3_union_full", "A9_union_summary", "P11_leave_target",
        "A1_quant_profile_union", "A2_qual_profile_union", "A4_missing_report_table2", "A5_sentinels_table2",
        "A7_outlier_summary_table1", "T1_pearson", "T2_spearman", "T3_kendall_tau_b", "T4_T5_chi2_cramers_v",
        "T6_T8_kruskal_anova", "G1_histogram_lineitem_price", "G5_box_stats", "F12_model_matrix",
        "F17_stratified_split", "M11_binary_metrics", "T10_T11_mcnemar"]


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return int(v) if isinstance(v, bool) else v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(table_path(SF, t)):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return c


def test_every_query_has_a_key_prefix():
    for k in entry.queries():
        assert k.split("_")[0][0].isalpha()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", FAST)
def test_query_matches_oracle(spark, con, key):
    sdf = entry.queries()[key](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(entry.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(ocols)
    assert _bag(sdf.columns, srows) == _bag(ocols, cur.fetchall())


def test_entry_smoke(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) >= 2 and {r["source"] for r in rows} == {"table1", "table2"}
