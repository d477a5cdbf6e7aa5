"""Every query with SQL matches it on the smallest tables."""

from __future__ import annotations

import pytest

from tests.conftest import DATA
from tests.oracle import differences
from turnlens.plans import catalog


#: Queries whose steps feed one another; tests/test_loop.py and tests/test_dialogue.py hold them.
WITHOUT_SQL = {"adaptive_loop", "static_dialogue"}


def test_every_other_query_has_sql():
    assert set(catalog.QUERIES) - WITHOUT_SQL == set(catalog.SQL)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, tmp_path, name):
    more, less, _ = differences(spark, tmp_path, f"{DATA}/sf0.001", catalog.QUERIES[name], catalog.SQL[name])
    assert not more and not less, (more[:2], less[:2])
