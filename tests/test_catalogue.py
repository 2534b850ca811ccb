import pytest

import __spark_entry__ as entry
from sitebooks.plans import checking_sql, spark_queries
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = spark_queries(), checking_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, key):
    df = QUERIES[key](spark, FOLDER)
    assert compare(df, con, SQL[key]).startswith("ok")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("Cartesian", "NestedLoop", "Python", "Pandas"):
        assert bad not in plan


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_the_entry_registers_the_catalogue():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert "labor_gross_profit" in df.columns and df.count() > 0


def test_profit_goldens(spark):
    got = QUERIES["monthly_profit"](spark, "/root/testdata/sf0.01")
    sums = got.groupBy().sum("income", "material_cost", "labor_cost", "expenses").first()
    assert [round(x, 2) for x in sums] == [776739872.70, 152865785.67, 153531134.94, 455418696.30]
    quarters = QUERIES["quarterly_profit"](spark, "/root/testdata/sf0.01").groupBy().sum("net_result").first()[0]
    assert quarters == pytest.approx(got.groupBy().sum("net_result").first()[0])


def test_reconcile_goldens(spark):
    folder = "/root/testdata/sf0.01"
    assert QUERIES["reconcile_bills_ledger_only"](spark, folder).count() == 1067
    assert QUERIES["reconcile_bills_system_b_only"](spark, folder).count() == 1055
