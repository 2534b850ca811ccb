"""Two record systems side by side: payments, days, subcontract lookups, payroll."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    append_total,
    append_total_to_rows,
    drop_first_match,
    joined,
    map_columns,
    matches,
    quantiles,
    serial_day,
    total,
    total_or_null,
)
from ..session import kept
from .ledger import alias_equal, first_hit
from .profit import Day, within
from .receivables import missing_in_other

# Words of a payroll memo and the concept they mean, the first hit counts.
PAYROLL_CONCEPTS = (("tax", "tax"), ("wage", "wage"), ("fees", "fees"), ("payr", "fees"))
MEMO_WIDTH = 8
WAGES = "WAGE PAY"

_KEYS = ("date", "amount")


def system_b_payments(payments: DataFrame, project: str | None = None, zero_missing: bool = True) -> DataFrame:
    """Date and amount of the second system's payments, of one project if wanted."""
    rows = payments if project is None else payments.where(matches("project", project))
    pairs = rows.select(F.col("payment_date").alias("date"), F.col("amount_paid").alias("amount"))
    return pairs.fillna(0, ["amount"]) if zero_missing else pairs


def only_in_first(first: DataFrame, second: DataFrame) -> DataFrame:
    """(date, amount) rows of one system without a partner in the other."""
    return missing_in_other(first.select(*_KEYS), second, list(_KEYS))


def reconcile_totals(ledger_rows: DataFrame, system_b: DataFrame) -> DataFrame:
    """Totals of both systems, of what only one has, and the reconciled total.

    Both sides are counted per (date, amount) before they meet.  The reconciled
    total is the second system's, less what only it has, plus what it lacks.
    """

    def counted(rows: DataFrame, into: str) -> DataFrame:
        return rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias(into))

    both = joined(counted(ledger_rows, "n_a"), counted(system_b, "n_b"), list(_KEYS), "full_outer")
    n_a, n_b = F.col("n_a"), F.col("n_b")

    def amount(n, where=None):
        value = F.col("amount") * n
        value = value if where is None else F.when(where, value)
        return F.coalesce(F.sum(value), F.lit(0)).cast("decimal(38,2)")

    totals = both.agg(
        amount(n_a).alias("total_ledger"),
        amount(n_b).alias("total_b"),
        amount(n_a, n_b.isNull()).alias("only_ledger"),
        amount(n_b, n_a.isNull()).alias("only_b"),
    )
    return totals.withColumn("reconciled", F.expr("total_b - only_b + only_ledger"))


def day_in_ledger(ledger: DataFrame, project: str, day: Day) -> DataFrame:
    """Ledger rows of one project and day with a total row."""
    rows = ledger.where(matches("customer", project) & (F.col("date") == F.lit(day).cast("date")))
    return append_total_to_rows(rows.drop("customer", "split", "account"), "type")


def day_in_system_b(payments: DataFrame, project: str, day: Day) -> DataFrame:
    """The second system's payments of one project and day with a total row."""
    rows = payments.where(matches("project", project) & (F.col("payment_date") == F.lit(day).cast("date")))
    named = rows.withColumnsRenamed(
        {"payment_date": "date", "transaction_type": "type", "amount_paid": "amount"}
    )
    return append_total_to_rows(named.withColumn("name", F.trim("resource")).drop("resource"), "type")


# -- subcontract lookups -------------------------------------------------------------


def attach_subcontract(payments: DataFrame, subcontracts: DataFrame, projects: Mapping[str, str]) -> DataFrame:
    """Payments with the subcontract id of their project and service."""
    tidy = map_columns(payments.withColumn("transaction_date", serial_day("transaction_date")), F.trim)
    named = tidy.withColumn("project", alias_equal(F.col("project"), projects))
    listed = map_columns(subcontracts.select("subcontract_id", "project", "service"), F.trim)
    return joined(named, listed, ["project", "service"])


def missing_subcontract(payments: DataFrame, subcontracts: DataFrame, projects: Mapping[str, str]) -> DataFrame:
    """Distinct project and service pairs without a subcontract."""
    pairs = map_columns(payments.select("project", "service").distinct(), F.trim)
    named = pairs.withColumn("project", alias_equal(F.col("project"), projects)).distinct()
    listed = map_columns(subcontracts.where("subcontract_id is not null").select("project", "service"), F.trim)
    return missing_in_other(named, listed, ["project", "service"])


def paid_by_subcontract(payments: DataFrame, subcontracts: DataFrame, clue: str) -> DataFrame:
    """Paid per project, subcontract, service and resource next to the contract.

    A subcontract id stands for one contract, so payments are summed first and the
    contract joins the sums.
    """
    paid = (
        payments.where(matches("project", clue))
        .groupBy("project", "subcontract", "service", "resource")
        .agg(total_or_null("check").alias("check"))
    )
    contract = subcontracts.groupBy("subcontract").agg(F.max("contract").alias("contract"))
    return joined(paid, contract, ["subcontract"])


def payment_checker(payments: DataFrame, project: str) -> DataFrame:
    """Paid by subcontract and type of a project, with a total."""
    sums = (
        payments.where(matches("project", project))
        .groupBy("subcontract_name", "subcontract", "transaction_type")
        .agg(F.sum(F.coalesce("amount_paid", F.lit(0))).alias("amount"))
    )
    return append_total(sums, "subcontract_name")


def payments_on_date(payments: DataFrame, day: Day) -> DataFrame:
    """Paid on a day by project and subcontract, with a total."""
    when = F.lit(day).cast("date")
    sums = (
        payments.where(F.col("payment_date") == when)
        .groupBy("project", "subcontract", "subcontract_name")
        .agg(total_or_null("amount_paid").alias("amount"))
        .withColumn("payment_date", when)
    )
    return append_total(sums, "project")


# -- payroll ---------------------------------------------------------------------------


def payroll_rows(ledger: DataFrame, vendor: str, first: Day, last: Day, memo_prefix: str) -> DataFrame:
    """Direct-labor rows of the payroll vendor with a concept read from the memo."""
    text = F.lower(F.trim(F.substring(drop_first_match("memo", memo_prefix), 1, MEMO_WIDTH)))
    rows = ledger.where(
        matches("name", vendor)
        & (F.col("amount") > 0)
        & within(first, last)
        & ~matches("account", "Fees")
        & matches("account", "DL")
    )
    return rows.withColumn("concept", first_hit(text, PAYROLL_CONCEPTS, text)).drop("class", "customer", "num")


def payroll_concepts(payroll: DataFrame) -> DataFrame:
    sums = payroll.groupBy("concept").agg(F.count(F.lit(1)).alias("count"), F.sum("amount").alias("amount"))
    return append_total(sums, "concept")


def wages_by_date(payroll: DataFrame) -> DataFrame:
    wages = payroll.where(matches("memo", WAGES))
    return wages.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


def wages_with_total(payroll: DataFrame) -> DataFrame:
    """Wage payments in the order of their days, then those of unknown days, then the total."""
    wages = payroll.where(matches("memo", WAGES))
    rows = append_total_to_rows(wages.select(F.col("date").cast("string").alias("date"), "amount"), "date")
    return rows.orderBy((F.col("date") == "Total").eqNullSafe(True), F.asc_nulls_last("date"))


def wages_summary(payroll: DataFrame) -> DataFrame:
    """Number, days and five-number summary of the wage payments of one vendor and period."""
    # ends and quantiles are taken from the written wages, so the ledger is read once
    wages = kept(payroll.where(matches("memo", WAGES)).select("date", "amount"))
    amount = F.col("amount").cast("double")
    ends = wages.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.min(amount).alias("minimum"),
        F.avg("amount").cast("double").alias("mean"),
        F.max(amount).alias("maximum"),
    )
    shares = quantiles(wages, "amount", {"first_quartile": 0.25, "median": 0.5, "third_quartile": 0.75})
    both = ends.withColumn("quartiles", shares.select(F.struct("*")).scalar())
    order = ["n", "first_day", "last_day", "minimum", "quartiles.first_quartile", "quartiles.median", "mean"]
    return both.select(*order, "quartiles.third_quartile", "maximum")


def payroll_file_by_date(payroll_file: DataFrame) -> DataFrame:
    sums = payroll_file.groupBy("date").agg(total_or_null("net_paid").alias("amount"))
    labelled = sums.select(F.col("date").cast("string").alias("date"), "amount")
    return append_total(labelled, "date")


def payroll_proof(payroll: DataFrame, payroll_file: DataFrame) -> DataFrame:
    """Wages in the ledger against the payroll provider, day by day."""
    provider = payroll_file.groupBy("date").agg(total("net_paid", True).alias("net_paid"))
    both = joined(wages_by_date(payroll), provider, ["date"], "full_outer")
    return both.withColumn("matching", F.coalesce(F.col("amount") == F.col("net_paid"), F.lit(False)))


def days_before(as_of: dt.date, days: int) -> dt.date:
    return as_of - dt.timedelta(days=days)
