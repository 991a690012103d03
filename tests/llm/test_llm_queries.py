"""Every registered query of this subpackage on the smallest tables, against SQL where SQL can say it."""

from pathlib import Path

import pytest

from gridloom.llm.queries import QUERIES, SQL
from oracle import same

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        same(spark, name, QUERIES[name], SQL[name], DATA)
    else:
        assert QUERIES[name](spark, DATA).count() > 0
