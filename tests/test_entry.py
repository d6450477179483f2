"""The registered page-line queries against their SQL twins, on the smallest tables."""

import math
import os

import pandas as pd
import pytest

from quire.jobs import catalogue, curation, incremental, pixels, raw_documents, training  # noqa: F401

DIR = "/root/testdata/sf0.001"


def rows(frame, columns):
    clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else (round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted((tuple(clean(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are absent")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{DIR}/{t}')")
    got, want = catalogue.QUERIES[name](spark, DIR).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
