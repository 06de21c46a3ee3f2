"""Every query with an SQL twin equals it on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from loomstat import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or str(x) == "<NA>" or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, int | float) or getattr(getattr(x, "dtype", None), "kind", "") in "iuf" and getattr(x, "dtype", None) is not None else str(x)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    mine, theirs = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
