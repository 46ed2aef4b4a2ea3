"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera import catalog

SF = os.environ.get("TESSERA_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame):
    def cell(v):
        if isinstance(v, (list, np.ndarray)):
            return tuple(map(cell, v))
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return str(round(float(v), 8) + 0.0)
        return str(v)

    names = sorted(df.columns)
    return names, sorted(tuple(map(cell, r)) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        assert plain(got) == plain(duck.sql(catalog.SQL[name]).df())
    else:
        assert len(got.columns)
