"""Source order, records with line breaks, windows as a table, counted snapshots, repeatable results."""

import csv
import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sitebooks import sources
from sitebooks.functions import OrderedRows, in_windows, ordering
from sitebooks.operators import expenses, receivables

D = dt.date


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of a few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "0")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


# -- source order ------------------------------------------------------------------


def test_rows_follow_their_files_through_splits(spark, tmp_path, small_splits):
    for name in "ba":
        (tmp_path / f"{name}.csv").write_text("\n".join(f"{name}{i},{i % 7}" for i in range(500)))
    rows = sources.with_source_line(spark.read.schema("x string, y int").csv(str(tmp_path)))
    assert rows.rdd.getNumPartitions() > 8
    got = [r.x for r in rows.repartition(5).orderBy("source_line").collect()]
    assert got == [f"{name}{i}" for name in "ab" for i in range(500)]


def test_look_back_follows_the_files(spark, tmp_path, small_splits):
    """Two files; the service before a materials line is the one above it in its file, not the one sorted before it."""
    names = "date,type,num,name,account,amount"
    one = ["2020-01-02,Invoice,S2,CBT:A,4.Operational Income:Stucco Income,5", "2020-01-01,Invoice,S1,CBT:A,4.Material Income:Materials Income,6"]
    two = ["2020-01-09,Invoice,S9,CBT:B,4.Operational Income:Paint Income,7", "2020-01-01,Invoice,S0,CBT:B,4.Material Income:Materials Income,8",
           "2020-01-01,Invoice,S0,CBT:B,4.Material Income:Materials Income,9"]
    (tmp_path / "f1.csv").write_text("\n".join([names, *one]))
    (tmp_path / "f2.csv").write_text("\n".join([names, *two]))
    schema = "date date, type string, num string, name string, account string, amount decimal(18,2)"
    ledger = sources.with_source_line(spark.read.schema(schema).option("header", True).csv(str(tmp_path)))
    opened = spark.createDataFrame([("CBT", "S1", 1)], "clue string, num string, open_balance int")
    out = receivables.statement_compacted(receivables.statement_lines(ledger, ["CBT"]), opened)
    got = {r.amount: r.service for r in out.collect()}
    assert got == {Decimal(5): "stucco", Decimal(6): "stucco", Decimal(7): "paint", Decimal(8): "paint", Decimal(9): "paint"}


def test_slices_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SLICE_ROWS", 100)
    sizes = {}
    for n in (0, 50, 1000, 5000):
        placed = OrderedRows(spark.range(n), [F.col("id").asc()], unique=True)
        sizes[n] = placed.rows.select(ordering.SLICE).distinct().count()
        assert [r.run for r in placed.running_total("id", "run").orderBy("id").collect()] == [i * (i + 1) // 2 for i in range(n)]
    assert sizes[0] == 0 and sizes[50] == 1 and 8 <= sizes[1000] <= 10 and 40 <= sizes[5000] <= 50


# -- records -------------------------------------------------------------------------


def exported(rng, n):
    texts = ["plain", 'say "hi"', "two\nlines", 'a "b\n\n"c, d', "comma, here", "\r\nwindows\r\n", '""', "é😀", " x "]
    return [[f"{i}", rng.choice(texts), rng.choice(texts)] for i in range(n)]


@pytest.mark.parametrize("splits", [False, True])
def test_memos_with_line_breaks(spark, tmp_path, request, splits):
    if splits:
        request.getfixturevalue("small_splits")
    rng, wanted = random.Random(2), []
    for name in ("one", "two"):
        rows = exported(rng, 300)
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            out.write("Transaction Report\n2021\n")
            writer.writerow(["", "Date", "Memo/Description", "Name"])
            writer.writerows([["", f"{name}{i}", memo, who] for i, memo, who in rows])
        wanted += [(f"{name}{i}", memo, who) for i, memo, who in rows]
    got = sources.read_report_export(spark, str(tmp_path), ["Date", "Memo/Description", "Name"], source_line=True)
    assert got.columns == ["date", "memo_description", "name", "source_line"]
    placed = [(r.date, r.memo_description, r.name) for r in got.orderBy("source_line").collect()]
    assert placed == wanted


def test_windows_line_ends_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'T\r\n,"x\r\ny",b\r\n\r\n,c,d\r\n')
    (tmp_path / "b.csv").write_bytes(b"")
    got = [r.record for r in sources.read_records(spark, str(tmp_path)).orderBy("source_line").collect()]
    assert got == ["T", ',"x\r\ny",b', "", ",c,d"]


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"c,d\ne,f\n')
    with pytest.raises(Exception, match="quote is not closed"):
        sources.read_records(spark, str(tmp_path)).collect()


# -- windows --------------------------------------------------------------------------


def test_windows_equal_a_loop(spark):
    rng = random.Random(6)
    days = [D(1969, 11, 1) + dt.timedelta(days=rng.randrange(400)) for _ in range(600)] + [D(1970, 1, 15)] * 300 + [None]
    spans = [(rng.choice(days[:600]), rng.choice(days[:600])) for _ in range(40)] + [(D(1960, 1, 1), D(2000, 1, 1)), (None, D(1970, 1, 1))]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, day date")
    windows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(spans)], "k int, first date, last date")
    want = {(i, k) for i, d in enumerate(days) for k, (a, b) in enumerate(spans) if d and a and b and a <= d <= b}
    for width in (1, 31, 1000):
        df = in_windows(rows, "day", windows, "first", "last", width)
        got = [(r.i, r.k) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want
    plan = in_windows(rows, "day", windows, "first", "last")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert in_windows(rows, "day", windows.where("false"), "first", "last").count() == 0
    with pytest.raises(ValueError):
        in_windows(rows, "day", windows.withColumnRenamed("k", "i"), "first", "last")


def test_new_vendors_of_windows_equal_a_loop(spark):
    rng = random.Random(8)
    start = D(2020, 1, 1)
    data = []
    for _ in range(500):
        name = rng.choice([None, *(f"v{rng.randrange(40)}" for _ in range(9)), "Fuel"])
        data.append((start + dt.timedelta(days=rng.randrange(300)), "Bill", name, rng.choice(["Fuel", "Rent", None, "v3"]), Decimal(rng.randrange(9))))
    data += data[:20]
    spans = [(start + dt.timedelta(days=a), start + dt.timedelta(days=b), start + dt.timedelta(days=c)) for a, b, c in ((30, 31, 60), (20, 10, 250), (0, 100, 90), (100, 150, 151))]
    ledger = spark.createDataFrame(data, "date date, type string, name string, account string, amount decimal(18,2)")
    windows = spark.createDataFrame(spans, "initial date, future_first date, future_last date")
    want = set()
    for initial, first, last in spans:
        old = {(r[2], r[3]) for r in data if r[0] <= initial and r[2] and r[3]}
        names, accounts = {n for n, _ in old}, {a for _, a in old}
        want |= {(initial, first, last, *r, r[2] in accounts) for r in data if first <= r[0] <= last and r[2] and r[3] and r[2] not in names}
    got = [tuple(r) for r in expenses.new_vendors_in(ledger, windows).collect()]
    assert len(got) == len(want) and set(got) == want


# -- snapshots as bags -------------------------------------------------------------------


def bags(spark, rows):
    return spark.createDataFrame(rows, "day date, name string, amount decimal(18,2)")


def two_extracts():
    rng = random.Random(9)
    old = [(D(2020, 1 + i % 6, 1 + i % 28), rng.choice(["a", "", None, "b"]), Decimal(i % 9)) for i in range(400)] + [(None, "x", None)] * 3
    new = [r for r in old if r[0] is None or r[0].month != 2]
    february = [r for r in old if r[0] and r[0].month == 2]
    new += february[:-7] + [(D(2020, 2, 9), "added", Decimal(1))] * 4 + [february[0]] * 2 + [(D(2021, 1, 1), None, None)]
    return old, new


def expected_changes(old, new):
    delta = Counter(new)
    delta.subtract(Counter(old))
    return sorted(((*row, n) for row, n in delta.items() if n), key=repr)


def test_bag_delta_is_except_all_both_ways(spark):
    old, new = two_extracts()
    a, b = bags(spark, old), bags(spark, new)
    got = receivables_sorted(sources.bag_delta(b, a))
    assert got == expected_changes(old, new)
    assert sum(r[-1] for r in got if r[-1] > 0) == b.exceptAll(a).count()
    assert -sum(r[-1] for r in got if r[-1] < 0) == a.exceptAll(b).count()
    assert sources.bag_delta(a, a).count() == 0


def receivables_sorted(df):
    return sorted((tuple(r) for r in df.select("day", "name", "amount", "copies").collect()), key=repr)


def test_stored_snapshots_read_changed_parts_only(spark, tmp_path):
    path, month = f"{tmp_path}/book", F.date_format("day", "MM")
    old, new = two_extracts()
    sources.write_counted_snapshot(bags(spark, new), path, D(2021, 5, 1), month)  # replaced below
    sources.write_counted_snapshot(bags(spark, old), path, D(2021, 5, 1), month)
    sources.write_counted_snapshot(bags(spark, new), path, D(2021, 5, 2), month)
    assert sources.changed_parts(spark, path, D(2021, 5, 1), D(2021, 5, 2)) == ["part:01", "part:02"]
    changes = sources.snapshot_changes(spark, path, D(2021, 5, 1), D(2021, 5, 2))
    assert receivables_sorted(changes) == expected_changes(old, new)
    scans = [line for line in changes._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert len(scans) >= 4 and all("snapshot_part#" in s.split("PartitionFilters: ")[1] and "part:01,part:02" in s for s in scans)
    same = sources.snapshot_changes(spark, path, D(2021, 5, 2), D(2021, 5, 2))
    assert same.count() == 0
    sources.write_counted_snapshot(bags(spark, new).where("false"), path, D(2021, 5, 3), month)
    gone = sources.snapshot_changes(spark, path, D(2021, 5, 2), D(2021, 5, 3))
    assert receivables_sorted(gone) == expected_changes(new, [])


# -- runs ---------------------------------------------------------------------------------


def test_a_failing_write_leaves_the_result_whole(spark, tmp_path):
    path = f"{tmp_path}/book"
    assert sources.current_run(spark, path) is None
    with pytest.raises(FileNotFoundError):
        sources.read_run(spark, path, "a")
    sources.publish_run({"a": spark.range(3), "b": spark.range(4)}, path, "one")
    broken = spark.range(1000).select(F.when(F.col("id") == 999, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    for _ in range(2):  # fails, and fails again when repeated
        with pytest.raises(Exception):
            sources.publish_run({"a": spark.range(30), "b": broken}, path, "two")
        assert sources.current_run(spark, path) == "one"
        assert [sources.read_run(spark, path, n).count() for n in "ab"] == [3, 4]
    keyed = spark.range(40).withColumn("k", F.col("id") % 4)
    sources.publish_run({"a": spark.range(30), "b": keyed}, path, "two", {"b": ["k"]})
    assert sources.current_run(spark, path) == "two"
    assert [sources.read_run(spark, path, n).count() for n in "ab"] == [30, 40]
    assert sources.read_run(spark, path, "b").where("k = 2").count() == 10
    assert sources.read_run(spark, path, "a", "one").count() == 3
    sources.publish_run({"a": spark.range(31)}, path, "two")  # repeated under its id
    assert sources.read_run(spark, path, "a").count() == 31
    with pytest.raises(ValueError):
        sources.publish_run({}, path)
