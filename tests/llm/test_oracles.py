"""The queries of this package that SQL can express against their SQL; the others run whole."""

import pytest
from comparison import SF, database, differences

from tidewire.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_sql(spark, name):
    assert not differences(llm.QUERIES[name](spark, SF), llm.ORACLE_SQL[name], database())
