"""Every query with SQL gives DuckDB's rows on the smallest given tables."""

import os

import duckdb
import pandas as pd
import pytest

from lectern.plans import registry

SF = "/root/testdata/sf0.001"


def canonical(df):
    def value(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, expected = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)
