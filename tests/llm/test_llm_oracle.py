from __future__ import annotations

import oracle
import pytest
from conftest import DATA, needs_data

from lexforge.llm.queries import ORACLE, QUERIES


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    assert oracle.differences(QUERIES[name](spark, DATA), oracle.connect(DATA), ORACLE[name]) == ""
