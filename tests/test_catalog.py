"""Every query runs, and agrees with its SQL twin, on the smallest tables."""

import os

import duckdb
import pytest

from polyvox import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    columns = sorted(df.columns)
    text = df[columns].astype(object).where(df[columns].notna(), "~").map(lambda v: f"{v:.9g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v))
    return columns, sorted(map(tuple, text.values))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert plain(got) == plain(duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(got.columns)
