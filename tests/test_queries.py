"""Every query of the library against its SQL, on whole tables."""

import duckdb
import pytest

from gleanspark import catalog

SF_DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    mine = catalog.queries()[name](spark, SF_DIR)
    theirs = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    kinds = dict(mine.dtypes)
    assert {d[0]: str(d[1]) for d in theirs.description} == {c: KINDS[kinds[c]] for c in names}
    rows = [tuple(r) for r in mine.select(*names).collect()]
    assert sorted(rows, key=str) == sorted(theirs.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0
