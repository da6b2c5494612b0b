"""Every market query with an SQL twin, row for row, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tapewright import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    """A value that both engines' frames give alike: numbers as doubles, missing ones as None."""
    if pd.isna(x):
        return None
    return x if isinstance(x, str | bool) or type(x).__name__ == "bool_" else float(x)


def rows_of(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return sorted((tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False)), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    # doubles last, so that rows line up even where one differs in its last digit
    columns = sorted(want.columns, key=lambda c: (want[c].dtype.kind == "f", c))
    got, want = rows_of(got, columns), rows_of(want, columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)
