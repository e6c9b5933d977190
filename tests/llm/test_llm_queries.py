import os

import oracle
import pytest

from tidewrack.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_spark_agrees_with_sql(spark, name):
    assert not oracle.differing(spark, oracle.connect(), queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE.keys()))
def test_queries_without_sql_run(spark, name):
    assert queries.QUERIES[name](spark, oracle.DATA).count() > 0
