"""Every registered query of the engine against DuckDB on the same files."""

import duckdb
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    clean = lambda x: None if x != x else x
    return sorted(tuple(str(clean(x)) for x in r) for r in values)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows_as_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(want.columns) == columns
    got = rows(tuple(r) for r in df.select(columns).collect())
    assert got == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_whole_tables_grow_with_the_input(spark):
    """Every customer is in the time travel and in the merge (all fifths are inserted, two thirds of the others stay)."""
    sf = "/root/testdata/sf0.01"
    keys = [r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    for name in ("time_travel_version", "time_travel_timestamp"):
        assert catalogue.QUERIES[name](spark, sf).count() == len(keys) > 1000
    merged = {r.c_custkey: r.c_acctbal for r in catalogue.QUERIES["merge_into"](spark, sf).collect()}
    assert set(merged) == {k for k in keys if k % 5 == 0 or k % 3}
    assert all(merged[k] == -1 for k in keys if k % 5 == 0)
