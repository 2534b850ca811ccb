"""Cleaning and classifying the accounting ledger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    joined,
    map_columns,
    matches,
    money,
    parse_day,
    quarter_label,
    tidy_text,
    total_or_zero,
    year_month,
)

# Account patterns of the six profit categories.
OPERATIONAL_INCOME = ".Operational Income:"
BILLABLE_INCOME = "Billable"
MATERIAL_INCOME = "Material Income:"
DIRECT_LABOR = "Direct Labor"
DIRECT_MATERIAL = "Direct Material"
# Accounts that count as expense although the expense report may lack them.
ALWAYS_EXPENSE = ("Automobile Expense:Leasing", "Other Expenses:Storage Rent")
# Fixed value: accounts that make up the cost of a project.
COST_ACCOUNTS = "Indirect|Labor|Direct Material|Fees|Services|Officer"
# Account word -> cost concept, the first hit counts.
CONCEPTS = (
    ("Materials", "Materials"),
    ("Labor", "Labor"),
    ("Supplies", "Materials"),
    ("Tools", "Materials"),
    ("Fees", "Materials"),
    ("S00", "Invoice"),
)
SHORT_CONCEPTS = (("Materials", "Materials"), ("Supplies", "Materials"), ("Labor", "Labor"))


def clean_export(raw: DataFrame, latest_first: bool = False) -> DataFrame:
    """Typed ledger from an all-text accounting export.

    Subtotal lines (no date) go, texts are trimmed, amounts that are no number
    become null, and the creation and modification stamps are parsed.
    """

    def stamp(column: str) -> Column:
        return F.try_to_timestamp(column, F.lit("M/d/yyyy H:m:s")).cast("timestamp_ntz")

    texts = map_columns(raw.where(F.col("date").isNotNull()), tidy_text)
    typed = texts.withColumns(
        {
            "amount": money("amount"),
            "date": parse_day("date", "M/d/yyyy"),
            "creation_date": stamp("create_date"),
            "modification_date": stamp("last_modified"),
        }
    )
    clean = typed.withColumnsRenamed({"transaction_type": "type", "memo_description": "memo"}).drop(
        "create_date", "last_modified"
    )
    return clean.orderBy(F.desc_nulls_last("creation_date")) if latest_first else clean


def clean_exports(exports: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Clean the transaction, expense and invoice exports in one call."""
    return {name: clean_export(raw) for name, raw in exports.items()}


def expense_accounts(expense_report: DataFrame) -> DataFrame:
    """Distinct accounts that count as expense."""
    always = F.explode(F.array(*[F.lit(a) for a in ALWAYS_EXPENSE])).alias("account")
    literal = expense_report.sparkSession.range(0, 1, 1, 1).select(always)
    return expense_report.select("account").unionByName(literal).distinct()


def _source(account: Column, is_expense: Column) -> Column:
    return (
        F.when(is_expense, "expense")
        .when(account.rlike("Income:"), "income")
        .when(account.rlike("Billable"), "income")
        .when(account.rlike(DIRECT_LABOR), "labor_cost")
        .when(account.rlike(DIRECT_MATERIAL), "material_cost")
        .otherwise(account)
    )


def weighted_ledger(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows of the six categories with ``source`` and ``copies``.

    A row counts once per category it falls into.  Aggregates multiply by
    ``copies`` instead of repeating the row, so one scan does for all categories.
    Unknown amounts count as zero.  ``accounts`` are the expense accounts; the
    rows may be ledger rows or, cheaper, sums that still carry the account.
    """
    marked = joined(ledger, accounts.withColumn("is_expense", F.lit(True)), ["account"])
    is_expense = F.coalesce("is_expense", F.lit(False))
    patterns = (OPERATIONAL_INCOME, BILLABLE_INCOME, MATERIAL_INCOME, DIRECT_LABOR, DIRECT_MATERIAL)
    copies = is_expense.cast("int")
    for pattern in patterns:
        copies = copies + matches("account", pattern).cast("int")
    return (
        marked.withColumns(
            {
                "copies": copies,
                "source": _source(F.col("account"), is_expense),
                "amount": F.coalesce("amount", F.lit(0)),
            }
        )
        .drop("is_expense")
        .where("copies > 0")
    )


def classified_sums(ledger: DataFrame, expense_report: DataFrame, **by: Column) -> DataFrame:
    """Category sums per ``by`` keys, account and source.

    Account decides the category, so the ledger is summed per account first and
    only those few sums meet the expense accounts.
    """
    keys = [c.alias(name) for name, c in by.items()]
    sums = ledger.groupBy(*keys, "account").agg(total_or_zero("amount").alias("amount"))
    weighted = weighted_ledger(sums, expense_accounts(expense_report))
    return weighted.withColumn("amount", F.col("amount") * F.col("copies")).drop("copies")


def classified_ledger(ledger: DataFrame, expense_report: DataFrame) -> DataFrame:
    """The classified ledger as rows; a row in two categories appears twice."""
    accounts = expense_accounts(expense_report)
    rows = weighted_ledger(ledger, accounts)
    periods = {"year_month": year_month("date"), "year_quarter": quarter_label("date")}
    repeated = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.withColumns(periods).drop("__copy", "copies", "modification_date")


def first_hit(value: Column, table: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """Label of the first regex that is found in ``value``."""
    chosen = None
    for pattern, label in table:
        test = value.rlike(pattern)
        chosen = F.when(test, label) if chosen is None else chosen.when(test, label)
    return chosen.otherwise(default) if default is not None else chosen


def cost_concept(account: Column, table: Sequence[tuple[str, str]] = CONCEPTS) -> Column:
    """Materials, Labor or Invoice by the words of an account, else the account itself."""
    return first_hit(account, table, account)


def alias_equal(value: Column, names: Mapping[str, str], keep_unlisted: bool = True) -> Column:
    """Canonical name of a listed name; unlisted names stay or become null."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for old, new in names.items():
        chosen = chosen.when(value == old, new)
    return chosen.otherwise(value) if keep_unlisted else chosen


def alias_matching(
    value: Column, patterns: Sequence[tuple[str, str]], keep_unlisted: bool = True
) -> Column:
    """Canonical name by the first regex that fits."""
    return first_hit(value, patterns, value if keep_unlisted else None)


def normalise_days(df: DataFrame, columns: Sequence[str] = ("date", "due_date")) -> DataFrame:
    """Dates written year-first or month-first become dates, row by row."""
    return df.withColumns({c: parse_day(c, "yyyy-MM-dd", "MM/dd/yyyy") for c in columns})
