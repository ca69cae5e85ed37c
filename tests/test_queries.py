"""Every query with SQL equals DuckDB by value; the others run and keep their columns."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect

# Fits that take many rounds; their results are tested in test_models.py.
SLOW = {"l7_ablate", "l8_sensitivity", "l9_leave_one_source_out", "l10_held_out_scores", "g1_train_arms",
        "g2_oof_probabilities", "g1_compare_arms", "l13_dawid_skene", "l14_dawid_skene_map", "l15_fit_latent_multi"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_contract():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_eight_rules(spark):
    assert entry(spark).count() == 8


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, con, sf, name):
    ok, note = compare(spark, con, name, queries()[name], oracle_sql()[name], sf)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_runs(spark, sf, name):
    df = queries()[name](spark, sf)
    assert df.columns and df.count() > 0
