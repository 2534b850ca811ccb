import datetime as dt

from pyspark.sql import functions as F

from sitebooks import sources
from sitebooks.operators import estimate, ledger, profit

FOLDER = "/root/testdata/sf0.001"


def test_upload_csv_to_budget(spark, tmp_path):
    path = f"{tmp_path}/toff"
    sources.view(spark, FOLDER, "takeoff_upload").write.option("header", True).csv(path)
    read = sources.read_takeoff_csv(spark, path)
    direct = estimate.stucco_budget(sources.view(spark, FOLDER, "takeoff_upload"))
    assert sorted(map(str, estimate.stucco_budget(read).collect())) == sorted(map(str, direct.collect()))


def test_report_export(spark, tmp_path):
    lines = ["Transaction Report", "2021", ",Date,Create Date", ",1/5/2021,x", ",,y", ",2/5/2021,z"]
    (tmp_path / "export.csv").write_text("\n".join(lines))
    got = sources.read_report_export(spark, str(tmp_path), ["Date", "Create Date"])
    assert got.columns == ["date", "create_date"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [("1/5/2021", "x"), (None, "y"), ("2/5/2021", "z")], key=repr)


def test_workbook_sheet_and_folder(spark, tmp_path):
    a, b = spark.range(3), spark.range(4)
    sources.write_workbook({"a": a, "b": b}, f"{tmp_path}/book")
    assert sources.read_sheet(spark, f"{tmp_path}/book/b").count() == 4
    merged = sources.read_folder(spark, f"{tmp_path}/book")
    assert merged.count() == 7 and merged.select("file").distinct().count() >= 2
    sources.write_table(a.withColumn("sheet", F.lit("one")).unionByName(b.withColumn("sheet", F.lit("two"))),
                        f"{tmp_path}/flat")
    sources.write_per_key(sources.read_sheet(spark, f"{tmp_path}/flat"), f"{tmp_path}/sheets", "sheet")
    assert sources.read_named_sheet(spark, f"{tmp_path}/sheets", "two").count() == 4


def test_snapshots_keep_other_days(spark, tmp_path):
    path = f"{tmp_path}/snap"
    for day, n in ((1, 2), (2, 3), (2, 5)):
        sources.write_snapshot(spark.range(n), path, dt.date(2021, 1, day))
    got = {r[0].day: r[1] for r in spark.read.parquet(path).groupBy("snapshot_date").count().collect()}
    assert got == {1: 2, 2: 5}


def test_stored_ledger_pushes_filters_and_columns(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    sources.write_table(sources.ledger(spark, FOLDER), path)
    stored = sources.read_sheet(spark, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = profit.period_invoiced(stored, "1996-01-01", "2001-06-20")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,Invoice)" in plan and "GreaterThanOrEqual(date,1996-01-01)" in plan
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "memo" not in schema and "split" not in schema


def test_classified_ledger_scans_the_ledger_once(spark, tmp_path):
    sources.write_table(sources.ledger(spark, FOLDER), f"{tmp_path}/ledger")
    sources.write_table(sources.view(spark, FOLDER, "expense_report"), f"{tmp_path}/report")
    out = ledger.classified_ledger(spark.read.parquet(f"{tmp_path}/ledger"), spark.read.parquet(f"{tmp_path}/report"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "SortMergeJoin" not in plan


def test_sql_text(spark):
    rows = sources.ledger(spark, FOLDER, "type", "amount")
    got = sources.sql_over({"transactions": rows}, "select count(*) as n from transactions where type = 'Invoice'")
    assert got.first()["n"] == rows.where("type = 'Invoice'").count()
    assert sources.first_rows(rows).count() == 6
