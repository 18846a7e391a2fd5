"""Every registered query that has SQL gives DuckDB's rows, on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from meridian.queries import QUERIES, SQL
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    if isinstance(v, Decimal | float):
        return float(f"{float(v):.9g}")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert columns
        return
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(dict(zip(names, x, strict=True))[c]) for c in columns) for x in r.fetchall()), key=repr)


def test_entry_module_without_the_training_data_operators(spark):
    """The rest of the library needs nothing of the subpackage."""
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'top_contributors' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
