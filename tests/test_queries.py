"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from kelpline.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(d[0] for d in want.description)
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.queries())
    assert e.entry(spark).columns == ["p_partkey", "p_name", "p_brand", "tier"]
