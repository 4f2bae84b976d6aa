"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from phraseforge.plans import catalogue, more

QUERIES, ORACLE_SQL = catalogue.QUERIES | more.QUERIES, catalogue.ORACLE_SQL | more.ORACLE_SQL

DATA = "/root/testdata/sf0.01"


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), names)
