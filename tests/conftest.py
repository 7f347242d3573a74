from __future__ import annotations

import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from lexforge.session import get_spark, ship  # noqa: E402

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="session")
def spark():
    s = get_spark("4", 4, "4g")
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    """All tables without rows."""
    return _variant(spark, str(tmp_path_factory.mktemp("empty")), lambda df: df.limit(0))


@pytest.fixture(scope="session")
def wide_dir(spark, tmp_path_factory):
    """All tables with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["record_id", "field", "value", "term", "content", "class_id", "payload", "kind", "pos_", "size", "item_id", "pre", "_packed", "form", "share", "n", "_row", "lemma_", "word", "sig"]
    return _variant(spark, str(tmp_path_factory.mktemp("wide")), lambda df: df.withColumns({c: F.lit(c) for c in names if c not in df.columns}))


def _variant(spark, to, change):
    for f in os.listdir(DATA):
        change(spark.read.parquet(f"{DATA}/{f}")).coalesce(1).write.parquet(f"{to}/{f}")
    return to


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
