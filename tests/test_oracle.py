"""Every query of the core with SQL against DuckDB; the others run and give a stable schema."""

from __future__ import annotations

import oracle
import pytest
from conftest import DATA, needs_data

from lexforge.plans import problems, reference

QUERIES, ORACLE = problems.QUERIES | reference.QUERIES, problems.ORACLE | reference.ORACLE


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, DATA), con, ORACLE[name]) == ""


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns
    assert df.count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"nmf_topic_terms", "als_topic_terms", "lemma_vectors", "pca_reduced", "top_components_removed"}))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() <= 2
