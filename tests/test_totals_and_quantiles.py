"""One-pass totals over rows, quantiles by selection, months that follow the data."""

import datetime as dt
import random
import statistics
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitebooks import sources
from sitebooks.functions import append_total, append_total_to_rows, quantiles
from sitebooks.operators import expenses, receivables, reconcile

FOLDER = "/root/testdata/sf0.001"
D = dt.date


# -- totals ------------------------------------------------------------------------


def lines(spark):
    rows = [("a", "x", 1, Decimal("1.10"), D(2020, 1, 1))] * 3 + [
        ("a", None, None, Decimal("2.25"), None), ("b", "Total", 4, None, D(2020, 1, 2)), (None, "x", 5, Decimal("-1.00"), None),
    ]
    return spark.createDataFrame(rows, "k string, label string, n int, amount decimal(18,2), day date")


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("keep", ["true", "k = 'a'", "false"])
def test_rows_with_total_equal_the_union(spark, rows, by, keep):
    df = lines(spark).where(keep)
    assert rows(append_total_to_rows(df, "label", by)) == rows(append_total(df, "label", by))
    assert append_total_to_rows(df, "label", by).columns == df.columns


def test_rows_and_total_come_from_one_scan(spark, tmp_path):
    sources.write_table(sources.ledger(spark, FOLDER), f"{tmp_path}/ledger")
    sources.write_table(sources.view(spark, FOLDER, "invoices"), f"{tmp_path}/invoices")
    sources.write_table(sources.view(spark, FOLDER, "payments_b"), f"{tmp_path}/payments")
    ledger, invoices, payments = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("ledger", "invoices", "payments"))
    texts = ledger.withColumn("date", F.col("date").cast("string"))
    numbers = invoices.select("num").limit(5)
    paid = invoices.select(F.col("date").cast("string"), "num", "amount", "open_balance")
    one_scan = {
        "subset": (receivables.invoice_subset_total(texts, numbers), "/ledger"),
        "ledger day": (reconcile.day_in_ledger(texts, "BUILD", "1999-01-05"), "/ledger"),
        "other day": (reconcile.day_in_system_b(payments, "BUILD", "1999-01-05"), "/payments"),
        "paid": (receivables.invoices_paid_of(paid, ledger.select("num")), "/invoices"),
    }
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for name, (df, folder) in one_scan.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line and folder in line]
        assert len(scans) == 1, name


def test_very_many_copies_stay_spread(spark):
    """Copies of one row are counted per task, so none has to repeat them all."""
    df = spark.range(0, 200_000, 1, 16).select(F.lit("x").alias("t"), F.lit(2).alias("n"))
    out = append_total_to_rows(df, "t")
    assert out.count() == 200_001 and out.where("t = 'Total'").first()["n"] == 400_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = out.where("t = 'x'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in placed) <= 100_000


def test_total_of_wages_stands_last(spark):
    df = spark.createDataFrame([(D(2020, 2, 1), "WAGE PAY", 5), (D(2020, 1, 1), "WAGE PAY", 7), (None, "WAGE PAY", 1)], "date date, memo string, amount int")
    got = [tuple(r) for r in reconcile.wages_with_total(df).collect()]
    assert got == [("2020-01-01", 7), ("2020-02-01", 5), (None, 1), ("Total", 13)]


# -- quantiles -----------------------------------------------------------------------

WANTED = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p90": 0.9, "top": 1.0}


def brute(values):
    values = sorted(v for v in values if v is not None)
    return tuple(float(np.quantile(values, q)) if values else None for q in WANTED.values())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 997])
def test_quantiles_equal_brute_force(spark, n):
    rng = random.Random(n)
    values = [rng.choice([None, rng.gauss(0, 100), 7.0, 7.0]) for _ in range(n)]
    df = spark.createDataFrame([(v, "k") for v in values], "x double, __n string")
    got = quantiles(df.drop("__n"), "x", WANTED).collect()
    assert len(got) == 1 and tuple(got[0]) == pytest.approx(brute(values))


def test_quantiles_by_group(spark):
    """A hot group with two thirds of the rows, ties, unknown keys and a group of unknown values only."""
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "b", None]), Decimal(rng.randrange(50)) / 4) for _ in range(3000)] + [("void", None)] * 3
    df = spark.createDataFrame(data, "k string, x decimal(18,2)")
    got = {r.k: tuple(r)[1:] for r in quantiles(df, "x", WANTED, ["k"]).collect()}
    groups = {k: [float(x) for key, x in data if key == k and x is not None] for k in {k for k, _ in data}}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k] == pytest.approx(brute(values))
    assert quantiles(df.where("false"), "x", WANTED, ["k"]).count() == 0


def test_a_share_is_between_zero_and_one(spark):
    with pytest.raises(ValueError):
        quantiles(spark.createDataFrame([(1.0,)], "x double"), "x", {"q": 25})


def test_wages_summary_has_no_global_percentile(spark):
    data = [(D(2020, 1, 1 + i % 9), "WAGE PAY", Decimal(i * i) / 100) for i in range(201)]
    df = spark.createDataFrame(data, "date date, memo string, amount decimal(18,2)")
    out = reconcile.wages_summary(df)
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got, values = out.first(), [float(a) for _, _, a in data]
    assert (got["n"], got["minimum"], got["maximum"]) == (201, 0.0, 400.0)
    assert [got["first_quartile"], got["median"], got["third_quartile"]] == pytest.approx(statistics.quantiles(values, n=4, method="inclusive"))
    assert reconcile.wages_summary(df.where("false")).first()["median"] is None


# -- months ----------------------------------------------------------------------------


def expense_book(spark, *days):
    data = [(d, "Office Expenses:Paper", Decimal(10 + i)) for i, d in enumerate(days)] + [(D(1900, 1, 1), "Undeposited Funds", Decimal(1))]
    report = spark.createDataFrame([("Office Expenses:Paper",)], "account string")
    return spark.createDataFrame(data, "date date, account string, amount decimal(18,2)"), report


def test_months_follow_the_data(spark):
    ledger, report = expense_book(spark, D(1990, 3, 5), D(2005, 12, 31), D(1994, 7, 1), D(1994, 7, 2))
    matrix = expenses.expense_matrix(ledger, report)
    assert matrix.columns[2] == "mar_1990" and matrix.columns[-1] == "dec_2005" and len(matrix.columns) == 2 + 10 + 15 * 12
    row = matrix.first()
    assert (row["mar_1990"], row["dec_2005"], row["jul_1994"], row["jan_2000"]) == (10, 11, 25, 0)
    assert expenses.expense_by_month(matrix).agg(F.sum("amount")).first()[0] == 46
    zoomed = expenses.account_zoom(ledger, report).first()
    assert zoomed["all_period_sum"] == 46 and zoomed["sub_account"] == "Paper"


def test_months_of_awkward_ledgers(spark):
    ledger, report = expense_book(spark)
    assert expenses.expense_matrix(ledger, report).columns == ["main_account", "sub_account"]
    assert expenses.account_zoom(ledger, report).count() == 0
    with pytest.raises(ValueError, match="without a date"):
        expenses.expense_matrix(*expense_book(spark, None))
    with pytest.raises(ValueError, match="more than"):
        expenses.expense_matrix(*expense_book(spark, D(1021, 1, 1), D(2021, 1, 1)))
    asked = expenses.expense_matrix(*expense_book(spark, D(2020, 1, 1), D(2021, 1, 1)), between=(D(2021, 1, 1), D(2021, 2, 28)))
    assert asked.columns[2:] == ["jan_2021", "feb_2021"] and asked.first()["jan_2021"] == 11
