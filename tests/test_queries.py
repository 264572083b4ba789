"""Every query of the library equals its SQL on DuckDB at the smallest size."""

import duckdb
import pytest

from lecturelake.plans import queries as plans
from lecturelake.plans.inputs import BASE

from conftest import DATA

FOLDER = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the driver's tables")


def rows(table):
    """Rows as text without order; numbers to nine digits, whole ones without a point."""

    def text(v):
        if v is None:
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.9g}"
        return str(v)

    names = sorted(table.column_names)
    return names, sorted(tuple(map(text, r)) for r in zip(*(table.column(n).to_pylist() for n in names)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, str(FOLDER)).toArrow()
    want = duck.sql(plans.oracle_sql()[name]).to_arrow_table()
    assert rows(got) == rows(want)


def test_sizes_that_end_in_a_half_equal_sql(spark, tmp_path):
    """180.5 KB, 1.125 MB and 1.375 MB: halves go upwards on both sides."""
    spark.createDataFrame([(1, 1848.32, "1-URGENT"), (2, 11796.48, "2-HIGH"), (3, 14417.92, "x")], "o_orderkey long, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'" if t != "orders" else f"CREATE VIEW orders AS SELECT *, 1 AS o_custkey, 'F' AS o_orderstatus, DATE '2024-01-01' AS o_orderdate FROM '{tmp_path}/orders.parquet/*.parquet'")
    got, want = plans.queries()["fn_numbers"](spark, str(tmp_path)).toArrow(), c.sql(plans.oracle_sql()["fn_numbers"]).to_arrow_table()
    assert rows(got) == rows(want) and sorted(got.column("size").to_pylist()) == ["1.13 MB", "1.38 MB", "181 KB"]
