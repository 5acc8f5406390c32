"""Every query of the engine against another engine on the same tables."""

import math

import duckdb
import pytest
from stratalith.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return ("f", repr(v + 0.0)) if isinstance(v, float) and math.isfinite(v) else (type(v).__name__, str(v))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = con.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    df = queries()[name](spark, DIR)
    assert df.columns == names
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == want
