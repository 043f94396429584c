"""Queries without SQL return rows on the small scale factor."""
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL


# op9 returns no row where no text holds a secret
@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op9_")))
def test_query_has_rows(spark, name):
    assert entry.queries()[name](spark, SF_SMALL).count() > 0
