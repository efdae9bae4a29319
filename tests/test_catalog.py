"""The driver's contract: each query against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from veilscan.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.astype(object).where(df.notna(), None)
    return df.sort_values(list(df.columns), key=lambda c: c.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", catalog.SQL)
def test_query(spark, con, name):
    got, want = plain(catalog.QUERIES[name](spark, SF).toPandas()), plain(con.execute(catalog.SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got:
        bad = [(i, a, b) for i, (a, b) in enumerate(zip(got[c], want[c], strict=True)) if a != b and not (isinstance(a, float) and abs(a - b) < 1e-9)]
        assert not bad, (c, bad[:5])


def test_rows_only(spark):
    for name in catalog.QUERIES.keys() - catalog.SQL.keys():
        catalog.QUERIES[name](spark, SF).collect()
    assert catalog.flagship(spark, SF).columns[:3] == ["doc_id", "det_seq", "start"]
