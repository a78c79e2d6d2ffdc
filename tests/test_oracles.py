"""Every registered query against its SQL twin; queries without one must run and return rows."""

import pytest
from oracle import compare, connect

from sparkprep import catalog
from sparkprep.catalog.registry import r, rounded

FOLDER = "/root/testdata/sf0.01"
QUERIES, SQLS = catalog.load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_equal(name, spark, con):
    assert compare(spark, con, FOLDER, QUERIES[name], SQLS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQLS)))
def test_runs(name, spark):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_rounding_of_halves(spark, con):
    """Shares that end on a half of the last digit, and values no power of ten reaches, are rounded as in SQL."""
    values = [(i / 3200,) for i in range(-3200, 3201)] + [((2 * i + 1) / 2e6,) for i in range(0, 100_000, 5)]
    values += [(v,) for v in (float("inf"), float("-inf"), 1.7e308, 0.49999999999999994e-6, -0.0, None)]
    df = spark.createDataFrame(values, "x double")
    con.register("halves", df.toPandas())
    got = [row["x"] for row in rounded(df).collect()]
    want = [row[0] for row in con.execute(f"SELECT {r('x', 'x')} FROM halves").fetchall()]
    con.unregister("halves")
    assert got[:-1] == want[:-1] and got[-1] is None


def test_every_twin_has_a_query():
    assert set(SQLS) <= set(QUERIES)
