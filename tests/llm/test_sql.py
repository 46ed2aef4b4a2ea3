import os

import duckdb
import pytest

from tessera.llm.queries import QUERIES, SQL

SF = os.environ.get("TESSERA_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_sqls_rows(name, spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {f.name: kinds[f.dataType.simpleString()] for f in got.schema.fields} == types
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_every_query_runs(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, SF).count() > 0
