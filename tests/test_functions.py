import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sitebooks import functions as S


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first()["x"]


def test_unguarded_sum_is_null_with_a_null(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    out = df.groupBy("k").agg(S.total_or_null("v").alias("n"), S.total_or_zero("v").alias("z"))
    assert rows(out, "k", "n", "z") == [("a", None, 1), ("b", 2, 2)]


def test_sum_over_no_rows_is_zero(spark):
    assert spark.range(0).agg(S.total_or_zero("id").alias("x")).first()["x"] == 0


def test_regex_on_null_is_false(spark):
    assert one(spark, S.matches("t", "x"), t=None) is False
    assert one(spark, S.matches("t", "x"), t="axb") is True


def test_conditional_on_unknown_is_unknown(spark):
    cond = F.col("t") == "a"
    assert one(spark, S.if_known(cond, F.lit("y"), F.lit("n")), t=None) is None
    assert one(spark, S.if_known(cond, F.lit("y"), F.lit("n")), t="b") == "n"


def test_separate_drops_surplus_and_fills_missing(spark, rows):
    df = spark.createDataFrame([("a:b:c", 1), ("a", 2), (None, 3)], "t string, n int")
    out = S.separate(df, "t", ["x", "y"])
    assert out.columns == ["x", "y", "n"]
    assert rows(out, "n", "x", "y") == [(1, "a", "b"), (2, "a", None), (3, None, None)]


def test_only_first_match_is_replaced(spark):
    assert one(spark, S.drop_first_match("t", " ", "_"), t="a b c") == "a_b c"
    assert one(spark, S.drop_first_match("t", "income"), t="materials income income") == "materials  income"


@pytest.mark.parametrize("text, days", [("2021-03-04", "2021-03-04"), ("03/04/2021", "2021-03-04"), ("n/a", None)])
def test_two_date_formats(spark, text, days):
    got = one(spark, S.parse_day("t", "yyyy-MM-dd", "MM/dd/yyyy"), t=text)
    assert str(got) == str(days)


def test_spreadsheet_day(spark):
    assert one(spark, S.serial_day("t"), t="44197") == dt.date(2021, 1, 1)
    assert one(spark, S.serial_day("t", "1899-01-01"), t="44197") == dt.date(2020, 1, 4)


def test_month_ends(spark):
    d = F.col("t").cast("date")
    assert one(spark, S.last_day_of_previous_month(d), t="2021-03-15") == dt.date(2021, 2, 28)
    assert one(spark, S.quarter_label(d), t="2021-05-31") == "2021 Q2"
    assert one(spark, S.month_label(d), t="2021-05-31") == "may_2021"


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Total.SF", "Invoice Date", "invoiceDate"])
    assert S.clean_names(df).columns == ["total_sf", "invoice_date", "invoice_date_2"]
    assert S.clean_name("open_balance", "title") == "Open Balance"
    assert [S.clean_name(x) for x in ("DESCRIPCIÓN", "Año", "Amount #", "iPhone7", "2020 average")] == [
        "descripcion",
        "ano",
        "amount_number",
        "i_phone7",
        "x2020_average",
    ]
    assert S.clean_name("DESCRIPCIÓN", "title") == "Descripcion"


def test_unknown_keys_match(spark, rows):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("z", 3)], "k string, n int")
    right = spark.createDataFrame([(None, 10), ("a", 20), ("q", 30)], "j string, m int")
    assert rows(S.joined(left, right, [("k", "j")]), "n", "m") == [(1, 10), (2, 20), (3, None)]
    assert rows(S.joined(left, right, [("k", "j")], "left_semi"), "n") == [(1,), (2,)]
    assert rows(S.joined(left, right, [("k", "j")], "left_anti"), "n") == [(3,)]
    full = S.joined(left, right, [("k", "j")], "full_outer")
    assert rows(full, "k", "n", "m") == sorted(
        [(None, 1, 10), ("a", 2, 20), ("z", 3, None), ("q", None, 30)], key=repr
    )


def test_null_safe_join_is_an_equi_join(spark):
    left = spark.range(5).withColumn("v", F.lit(1))
    plan = S.joined(left, spark.range(5).withColumnRenamed("id", "j"), [("id", "j")])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_hot_key_is_split(spark):
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
    }
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        # half of all rows share one unknown key
        left = spark.range(0, 40_000, 1, 8).select(
            F.when(F.col("id") % 2 == 1, F.col("id") % 1000).alias("k"), F.hash("id").alias("v")
        )
        right = spark.range(1000).select(F.nullif(F.col("id"), F.lit(0)).alias("j"), F.lit(1).alias("w"))
        out = S.joined(left, right, [("k", "j")]).groupBy().agg(F.count("w").alias("n"))
        assert out.collect()[0]["n"] == 40_000
        final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "skew=true" in final
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_total_row(spark, rows):
    df = spark.createDataFrame(
        [("p", "a", "x", 1, dt.date(2020, 1, 1)), ("p", "b", "y", None, None), ("q", "a", "x", 5, None)],
        "g string, k string, t string, n int, d date",
    )
    assert ("Total", "-", "-", 6, None) in rows(S.append_total(df, "g"))
    per_group = rows(S.append_total(df, "k", by=["g"]).where("k = 'Total'"), "g", "t", "n")
    assert per_group == [("p", "-", 1), ("q", "-", 5)]


def test_total_row_reads_the_source_once(spark, tmp_path):
    spark.range(100).select((F.col("id") % 5).alias("k"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/t")
    sums = spark.read.parquet(f"{tmp_path}/t").groupBy(F.col("k").cast("string").alias("k")).agg(F.sum("v").alias("v"))
    out = S.append_total(sums, "k")
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_repeated_text_equals_sorted_text(spark):
    texts = ["b", "a", "b", "c", "b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    counted = df.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    assert counted.agg(S.repeated_text("t", "n").alias("x")).first()["x"] == "a,b,b,b,c"
    assert df.agg(S.sorted_text("t").alias("x")).first()["x"] == "a,b,b,b,c"


def test_clues_match_in_one_scan(spark, rows):
    df = spark.createDataFrame([("9 Oak Lane",), ("Mill 9 Oak",), (None,), ("x",)], "c string")
    got = rows(S.with_clues(df, "c", ["9 Oak", "Mill"]), "c", "clue")
    assert got == sorted([("9 Oak Lane", "9 Oak"), ("Mill 9 Oak", "9 Oak"), ("Mill 9 Oak", "Mill")])


def test_containing_values_equals_brute_force(spark, rows):
    rng = random.Random(5)
    words = ["".join(rng.choice("ab#:.") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    clues = sorted({w[: rng.randint(1, 5)] for w in words[:60]} | {".", "not there", "a" * 20})
    got = S.containing_values(
        spark.createDataFrame([(w,) for w in words] + [(None,)], "v string"), "v",
        spark.createDataFrame([(c,) for c in clues] + [(None,)], "c string"), "c",
    )
    assert rows(got, "v", "c") == sorted(((w, c) for w in set(words) for c in clues if c in w), key=repr)


def _ordered(spark, values):
    return spark.createDataFrame(values, "k int, v int").repartition(5)


def test_running_total_equals_brute_force(spark):
    rng = random.Random(3)
    values = [(i, rng.randint(-50, 50)) for i in range(500)]
    rng.shuffle(values)
    out = S.OrderedRows(_ordered(spark, values), [F.asc("k")], unique=True).running_total("v", "r")
    seen, expected = 0, []
    for k, v in sorted(values):
        seen += v
        expected.append((k, seen))
    assert sorted((r["k"], r["r"]) for r in out.collect()) == expected


def test_previous_rows_with_very_many_copies(spark):
    # one row makes up most of the table; its copies must chain over range borders
    values = [(1, 10)] * 3500 + [(0, 7), (2, 20), (2, 20), (3, 30), (5, 50)]
    out = S.OrderedRows(_ordered(spark, values), [F.asc("k"), F.asc("v")]).with_previous("v", 2, "b")
    got = sorted((r["k"], r["v"], r["b1"], r["b2"]) for r in out.collect() if r["b2"] is not None)
    line = [v for _, v in sorted(values)]
    keys = [k for k, _ in sorted(values)]
    expected = sorted((keys[i], line[i], line[i - 1], line[i - 2]) for i in range(2, len(line)))
    assert got == expected and out.count() == len(values)


def test_money_text(spark):
    assert one(spark, S.money("t"), t="12.345") == Decimal("12.345")
    assert one(spark, S.money("t"), t="-1234567890123456789.01") == Decimal("-1234567890123456789.01")
    assert one(spark, S.money("t"), t="12.339999999999999858") == Decimal("12.34")
    for text in ("-", "", "NaN", "Infinity", "1,000", None):
        assert one(spark, S.money("t"), t=text or "") is None
    with pytest.raises(Exception, match="amount out of range"):
        one(spark, S.money("t"), t="1" + "0" * 25)
