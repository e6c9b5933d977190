import os

import oracle
import pytest

from tidewrack.operators import provider
from tidewrack.plans import knowledge, knowledge_sql, problems, reference, reference_sql

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")
QUERIES = {**problems.QUERIES, **reference.QUERIES, **knowledge.QUERIES}
SQL = {**problems.ORACLE, **reference_sql.ORACLE, **knowledge_sql.ORACLE}


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_spark_agrees_with_sql(spark, con, name):
    assert not oracle.differing(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, oracle.DATA).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["ref_table", "ref_field", "row_key", "kind", "period"]
    assert QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()


def test_every_artifact_is_chunked_and_extracted(spark):
    parts = reference.artifacts(spark, oracle.DATA)
    chunks = {r.artifact_id: r.chunk for r in reference.all_chunks(spark, oracle.DATA).collect()}
    assert chunks.keys() == {r.artifact_id for r in parts.select("artifact_id").collect()}
    want = {(chunks[i["artifact_id"]], i["artifact_id"], i["status"], i["span"], None) for i in provider.offline_extract([{"id": r.artifact_id, "text": r.text} for r in parts.select("artifact_id", "text").collect()])}
    assert {tuple(r) for r in reference.provider_items(spark, oracle.DATA).collect()} == want
