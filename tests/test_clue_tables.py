"""Clues that are data: the index of required literals against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitebooks.functions import containing_values, matching_values, required_literals
from sitebooks.operators import projects, receivables

# a clue and what a text must hold, per alternative; None where nothing is certain
READ = [
    ("BUILD", ["BUILD"]),
    ("BUILD|MACH", ["BUILD", "MACH"]),
    ("52 T|162 Sem|27 FLAM", ["52 T", "162 Sem", "27 FLAM"]),
    ("^Cust.*:AUTO$", [":AUTO"]),
    ("(BUILD|MACH)", ["BUILD", "MACH"]),
    ("(BUILD|MACH)ING", ["ING"]),
    ("ab?cd", ["cd"]),
    ("ab+cd", ["ab"]),
    ("ab{0,3}cd", ["cd"]),
    (r"Inc\. \(FL\)", ["Inc. (FL)"]),
    (r"\d{3} Harbor", [" Harbor"]),
    ("[abc]x|y", ["x", "y"]),
    ("(a(b|c)d)?House", ["House"]),
    (r"a\|b", ["a|b"]),
    ("", None), (".", None), ("[ab]+", None), ("a|", None), ("(?i)build", None), ("(?=x)y", None), (r"\x41bc", None),
    (r"(a)\1", None), ("[a[bc]]d", None), ("x*", None), ("a?", None),
]


def test_required_literals(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(READ)], "i int, clue string")
    got = {r.i: r.found for r in df.select("i", required_literals(F.col("clue")).alias("found")).collect()}
    assert {c: got[i] for i, (c, _) in enumerate(READ)} == dict(READ)


def pairs_of(texts, clues):
    return {(t, c) for t in set(texts) for c in set(clues) if t is not None and c is not None and re.search(c, t, re.A)}


def random_clue(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.6 or depth > 1:
            piece = "".join(rng.choice("abcAB.-") for _ in range(rng.randint(1, 4))).replace(".", r"\.")
        elif kind < 0.7:
            piece = rng.choice(["[ab]", "[^c]", r"\d", ".", r"\w"])
        else:
            piece = f"({random_clue(rng, depth + 1)}|{random_clue(rng, depth + 1)})"
        if rng.random() < 0.25:
            piece += rng.choice(["?", "*", "+", "{2}", "{0,1}", "+?"])
        parts.append(piece)
    clue = "".join(parts)
    return clue if rng.random() < 0.7 or depth else f"{clue}|{random_clue(rng, depth + 1)}"


def test_clue_table_equals_a_loop(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcAB.-1") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += ["é😀 (a)", "abc\ncab", "", None, "a" * 5000, *["hot text abc"] * 500]
    clues = [c for c, _ in READ if c != "[a[bc]]d"] + [random_clue(rng) for _ in range(150)] + [None, "😀 \\(", "bc\nca"]
    values = spark.createDataFrame([(t, 1) for t in texts], "name string, clue int")
    table = spark.createDataFrame([(c,) for c in clues], "clue string")
    got = [tuple(r) for r in matching_values(values, "name", table, "clue").collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_of(texts, clues)


def test_plain_texts_equal_a_loop(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab.(é") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, ""]
    clues = ["".join(rng.choice("ab.(é") for _ in range(rng.randint(0, 6))) for _ in range(120)] + [None, ""]
    got = containing_values(
        spark.createDataFrame([(t,) for t in texts], "name string"), "name",
        spark.createDataFrame([(c,) for c in clues], "clue string"), "clue",
    )
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(t, c) for t in set(texts) for c in set(clues) if t and c and c in t}


def test_empty_tables_and_too_many_loose_clues(spark):
    values = spark.createDataFrame([("a",)], "name string")
    none = values.where("false")
    clues = spark.createDataFrame([(f"[{c}]",) for c in "abcdef"], "clue string")
    assert matching_values(none, "name", clues, "clue").count() == 0
    assert matching_values(values, "name", clues.where("false"), "clue").count() == 0
    assert [r.clue for r in matching_values(values, "name", clues, "clue").collect()] == ["[a]"]
    with pytest.raises(ValueError, match="no literal"):
        matching_values(values, "name", clues, "clue", most_loose=5)


def test_index_joins_by_keys_and_leaves_unknown_customers_out(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.createDataFrame(
            [("Invoice", "Cust 1:BUILD", "4.Operational Income:x", 5), ("Invoice", None, "4.Operational Income:x", 7)],
            "type string, customer string, account string, amount int",
        )
        clues = spark.createDataFrame([("1:B.*D$",), (None,)], "project_name string")
        flow = projects.project_cashflow(rows, clues, regex=True)
        plan = flow._jdf.queryExecution().executedPlan().toString()
        for bad in ("Cartesian", "NestedLoop", "Python"):
            assert bad not in plan
        assert [(r.project, r.amount) for r in flow.collect()] == [("1:B.*D$", 5)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_state_of_a_clue_table(spark):
    ledger = spark.createDataFrame(
        [("Payment", "A 421 S", 30), ("Payment", "B 52 T", 5), ("Payment", None, 9), ("Invoice", "A 421 S", 8)],
        "type string, customer string, amount int",
    ).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    invoices = spark.createDataFrame(
        [("A 421 S", 100, 70), ("A 421 S", 1, 1), ("B 52 T", 5, 0), (None, 3, 3)], "name string, amount int, open_balance int"
    )
    clues = spark.createDataFrame([("421|52",), ("^B",), ("none here",), (None,)], "clue string")
    got = {r.project: (r.invoiced, r.total_paid, r.open_balance, r.logical_match)
           for r in receivables.state_by_clue_table(ledger, invoices, clues).collect()}
    assert got == {"421|52": (106, 35, 71, True), "^B": (5, 5, 0, True), "none here": (0, 0, 0, True), None: (0, 0, 0, True)}
