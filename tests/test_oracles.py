"""Registered queries against their SQL on the small tables.

A part of the queries by default; ORACLES=all runs every one.
"""

import os

import pytest

import __spark_entry__ as entry
import check_oracles

SOME = (
    "x1_parse_date", "x8_text_stats", "c3_impute_median", "c6_label_encode", "f1_financial_ratios", "f5_group_stats",
    "t1_income_features", "t9_transaction_features", "e7_all_metrics", "e8_optimize_threshold", "e11_lift", "d1_psi",
    "d4_ks_2samp", "d10_page_hinkley", "d12_adwin_like", "r8_recommend_pricing", "v2_transaction_rules",
    "m17_rank_attributions", "m27_tfidf", "g6_runs", "g8_as_of", "g16_graph_components", "s6_normalize_statement",
    "st1_stream_score", "st5_stream_sessions",
)


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("ORACLES") == "all" else SOME)
def test_query(spark, con, name):
    ok, message = check_oracles.check(spark, con, "/root/testdata/sf0.001", name)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
