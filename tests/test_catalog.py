"""Every query with SQL equals DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from percepta import plans as catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    def rows(df):
        cols = sorted(df.columns)
        df = df[cols].astype(object)
        return cols, sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))

    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
