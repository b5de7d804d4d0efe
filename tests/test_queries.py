from __future__ import annotations

import pytest

from tabmill.plans.queries import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLES:
        assert compare(spark, name, QUERIES[name], ORACLES[name], sf) == ""
    else:
        assert QUERIES[name](spark, sf).count() > 0
