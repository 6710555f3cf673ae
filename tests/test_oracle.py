"""Every registered query against its reference SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import check_queries  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tribolens.catalog import entries  # noqa: E402

SF = "/root/testdata/sf0.001"
# Fits over the same tables take long and are covered by test_flow.
SLOW = {"whole_analysis_cards", "model_leaderboard", "model_probabilities", "model_importance",
        "model_validation_summary", "model_sink"}


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SF)


def test_names_match():
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entries.QUERIES if n not in SLOW])
def test_query(spark, con, name):
    outcome, _, _, _ = check_queries.compare(spark, con, SF, name)
    assert outcome in ("ok", "rows only")
