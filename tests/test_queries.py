"""Every registered query with SQL gives DuckDB's rows; the rest run and keep their schema."""

import duckdb
import pytest

from logtide.queries import GENERATED_QUERIES, GENERATED_SQL, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "documents", "pages", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL | GENERATED_SQL))
def test_equals_sql(spark, db, name):
    want = db.sql((ORACLE_SQL | GENERATED_SQL)[name]).df()
    got = (QUERIES | GENERATED_QUERIES)[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    shown = [sorted(map(str, f[columns].itertuples(index=False, name=None))) for f in (got.astype(str), want.astype(str))]
    assert shown[0] == shown[1]


@pytest.mark.parametrize("name", ["drain_templates"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
