"""The pN_ queries against their SQL, and that all of them run."""

import pytest

pytest.importorskip("folioquery.llm")

from folioquery.llm import queries as llm  # noqa: E402
from tests.compare import connect, rows  # noqa: E402


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_as_sql(spark, data, name):
    assert rows(llm.queries()[name](spark, data).toPandas()) == rows(connect(data).sql(llm.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_runs(spark, data, name):
    assert llm.queries()[name](spark, data).count() >= 0
