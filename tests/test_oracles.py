"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from incrementa.plans.queries import all_oracles, all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("nan" if x is None or str(x) in ("<NA>", "nan") else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_oracle(spark, duck, name):
    got, want = all_queries()[name](spark, SF).toPandas(), duck.sql(all_oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert rows(got) == rows(want)
