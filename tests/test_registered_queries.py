"""Every registered query against its SQL counterpart on the smallest tables."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Fits dozens of models; covered by its own tests and run by the driver.
SLOW = {"forest_forecast", "boosting_forecast", "experiment_runs"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def in_order(rows, columns):
    """Columns by name, rows by their text; numbers stay numbers for the comparison."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]

    def place(row):
        exact = tuple(str(v) for v in row if not isinstance(v, float))
        return exact, tuple(v for v in row if isinstance(v, float))

    return sorted(picked, key=place)


def equal(left, right):
    """Engines add in different orders, so a value may round to a neighbouring sixth digit."""
    if isinstance(left, float) and isinstance(right, float):
        return math.isclose(left, right, abs_tol=2e-6)
    return left == right


@pytest.mark.parametrize("name", sorted(set(oracle_sql())))
def test_matches_sql(spark, database, name):
    df = queries()[name](spark, SF_DIR)
    cursor = database.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    mine = in_order(df.collect(), df.columns)
    theirs = in_order(cursor.fetchall(), columns)
    assert len(mine) == len(theirs)
    different = [
        (a, b) for a, b in zip(mine, theirs, strict=True) if not all(map(equal, a, b))
    ]
    assert not different, different[:3]


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert queries()[name](spark, SF_DIR).columns


def test_entry(spark):
    assert entry(spark).count() > 0
