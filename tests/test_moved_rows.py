"""What is shuffled, broadcast and read twice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitebooks import sources
from sitebooks.functions import in_changed_parts, matching_values
from sitebooks.operators import expenses, projects, receivables, reconcile

D1, D2, D3 = (dt.date(2021, 1, d) for d in (1, 2, 3))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def first_plan(spark):
    """Plans as they are before anything has been measured."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grams_of_a_clue_table_are_not_broadcast(spark, first_plan):
    values = spark.createDataFrame([("Customer 12:BUILD",), ("Customer 7:AUTO",)], "name string")
    clues = spark.createDataFrame([("^Customer 12[:]B.+",), ("none|AUTO$",)], "clue string")
    pairs = matching_values(values, "name", clues, "clue")
    joins = [x for x in plan_of(pairs).splitlines() if "BroadcastHashJoin" in x and "__gram" in x]
    assert joins == []
    assert {tuple(r) for r in pairs.collect()} == {
        ("Customer 12:BUILD", "^Customer 12[:]B.+"), ("Customer 7:AUTO", "none|AUTO$")
    }


def test_customers_meet_orders_and_parts_meet_lines_first(spark, first_plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = sources.ledger(spark, "/root/testdata/sf0.001", "date", "name", "customer", "account", "amount")
    lines = plan_of(rows.where("account like '%Labor%'")).splitlines()

    def below(key):
        at = next(i for i, x in enumerate(lines) if f"Exchange hashpartitioning({key}" in x)
        depth = lines[at].index("Exchange")
        inner = []
        for x in lines[at + 1 :]:
            if not x[: depth + 1].strip(" :+-|") == "":
                break
            inner.append(x)
        return "\n".join(inner)

    assert "o_orderdate" in below("o_custkey") or "o_orderkey" in below("o_custkey")
    assert "l_orderkey" not in below("o_custkey")
    # the filter on accounts is below the shuffle by orders, and prices are money there
    assert "Labor" in below("l_orderkey") and "p_partkey" in below("l_orderkey")


def test_parts_that_did_not_change_are_not_compared(spark):
    columns = "date date, name string, memo string, amount int"
    old = [(D1, "a", None, 1)] * 2 + [(D2, "b", None, 2), (D2, None, "b", 3), (None, "c", "d", 4), (D3, "gone", "x", 5)]
    # D2: an unknown value changed places; D1 and the unknown day stay
    new = [(D1, "a", None, 1)] * 2 + [(D2, None, "b", 2), (D2, None, "b", 3), (None, "c", "d", 4)]
    a, b = spark.createDataFrame(new, columns), spark.createDataFrame(old, columns)
    now, before = in_changed_parts(a, b, "date", a.columns)
    assert {r.date for r in now.collect()} == {D2} and {r.date for r in before.collect()} == {D2, D3}
    whole = sorted(map(tuple, sources.bag_delta(a, b).collect()), key=repr)
    assert sorted(map(tuple, sources.bag_delta(a, b, part="date").collect()), key=repr) == whole and len(whole) == 3
    # copies count in a bag
    more = a.union(a.limit(1))
    assert [r.copies for r in sources.bag_delta(more, a, part="date").collect()] == [1]
    # an unknown day is a part of its own
    none = a.where("date is null").withColumn("amount", F.lit(9))
    assert sources.bag_delta(none, a.where("date is null"), part="date").count() == 2


def test_rows_of_a_snapshot_with_parts(spark):
    columns = "date date, name string, amount int, memo string"
    new = spark.createDataFrame([(D1, "a", 1, "x"), (D1, "a", 1, "y"), (D2, None, 2, "z"), (D2, "n", 2, "z"), (None, "u", 1, "-")], columns)
    old = spark.createDataFrame([(D1, "a", 1, "q"), (D2, None, 2, "z"), (D3, "n", 2, "z")], columns)
    plain = sorted(map(tuple, receivables.snapshot_delta(new, old).collect()), key=repr)
    assert plain == sorted([(D2, "n", 2, "z"), (None, "u", 1, "-")], key=repr)
    assert sorted(map(tuple, receivables.snapshot_delta(new, old, part="date").collect()), key=repr) == plain
    assert receivables.snapshot_delta(new, new, part="date").count() == 0
    with pytest.raises(ValueError, match="memo"):
        receivables.snapshot_delta(new, old, part="memo")


@pytest.fixture
def book(spark, tmp_path):
    rows = [
        (D1, "Invoice", "S1", "v", None, "C 1:BUILD", "4.Operational Income:x", 5, "m"),
        (D2, "Bill", "S2", "v", "Framing", "C 1:BUILD", "Cost of Goods Sold:Direct Labor (DL):x", 7, "WAGE PAY"),
        (D2, "Bill", "S2", "w", "Framing", "C 2:BUILD", "Cost of Goods Sold:Direct Labor (DL):x", 4, "WAGE PAY"),
        (D3, "Bill", "S3", "w", "Framing", None, "Cost of Goods Sold:Direct Labor (DL):x", 9, "WAGE PAY"),
    ]
    kinds = "date date, type string, num string, name string, class string, customer string, account string, amount int, memo string"
    df = spark.createDataFrame(rows, kinds).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    df.write.parquet(f"{tmp_path}/book")
    return spark.read.parquet(f"{tmp_path}/book")


def reads(df):
    return [f for f in df.inputFiles() if "/book/" in f]


def test_cash_flows_read_the_ledger_once(spark, book):
    recent = spark.createDataFrame(
        [("C 1", "BUILD", 1, 5, "BUILD", "build.xlsx")],
        "customer string, project string, n int, volume int, project_name string, file_name string",
    )
    flow = projects.project_cashflow(book.drop("memo"), recent)
    levels = projects.cashflow_levels(book, recent)
    status = projects.project_status(book, recent)
    assert [reads(df) for df in (flow, levels, status)] == [[], [], []]
    assert sorted(int(r.amount) for r in flow.collect()) == [-7, -4, 5]
    # both customers' costs of a day, account and class are one line of the project
    assert sorted((r.direction, int(r.amount)) for r in levels.collect()) == [("inflow", 5), ("outflow", -11)]
    assert int(status.first()["status"]) == -6


def test_new_vendors_of_windows_read_the_ledger_once(spark, book):
    windows = spark.createDataFrame([(D1, D1, D3), (D2, D1, D3)], "initial date, future_first date, future_last date")
    found = expenses.new_vendors_in(book, windows)
    assert reads(found) == []
    # v was seen on the first day, w on the second: w is new to the first window only
    got = sorted((r.initial, r.date, r.name) for r in found.collect())
    assert got == [(D1, D2, "w"), (D1, D3, "w")]


def test_the_wages_summary_reads_the_ledger_once(spark, book):
    out = reconcile.wages_summary(book)
    assert reads(out) == []
    assert (out.first()["n"], out.first()["median"], out.first()["last_day"]) == (3, 7.0, D3)
