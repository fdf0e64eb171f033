"""Every registered query against its DuckDB oracle at sf0.01."""

import duckdb
import pytest

from conftest import SF_CHECK
from tableflow.queries import ORACLES, QUERIES
from tools.check_oracle import TABLES, rows_of, type_mismatches


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_CHECK}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_CHECK)
    s, scols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(ORACLES[name])
    assert type_mismatches(df.dtypes, rel.columns, rel.types) == {}
    o, ocols = rows_of(rel.columns, rel.fetchall())
    assert scols == ocols
    assert len(s) == len(o)
    assert s == o
