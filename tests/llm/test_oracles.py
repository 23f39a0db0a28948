"""Queries of the subpackage that SQL can express give the rows of their SQL."""

import pytest

from latticework.llm.queries import ORACLES, QUERIES

from ..compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, data_dir, name):
    assert_same(QUERIES[name](spark, data_dir), connect(data_dir), ORACLES[name])
