"""Monthly and quarterly profit, distributions and period results."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    matches,
    quarter_label,
    total,
    total_or_zero,
    total_where,
    year_month,
)
from .ledger import (
    COST_ACCOUNTS,
    DIRECT_LABOR,
    DIRECT_MATERIAL,
    MATERIAL_INCOME,
    OPERATIONAL_INCOME,
    classified_sums,
)

Day = dt.date | str
SUMMED = ("income", "material_cost", "labor_cost", "expenses")
MEASURES = (
    "income",
    "material_cost",
    "labor_cost",
    "labor_income",
    "total_cost",
    "operational_profit",
    "labor_gross_profit",
    "difference",
)


def within(first: Day, last: Day, column: str = "date") -> Column:
    return F.col(column).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def _ratio(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))


def with_results(sums: DataFrame) -> DataFrame:
    """Profit measures from income, material cost, labor cost and expenses.

    Ratios are null where the denominator is zero.
    """
    return (
        sums.withColumns(
            {
                "labor_income": F.col("income") - F.col("material_cost"),
                "total_cost": F.col("material_cost") + F.col("labor_cost"),
            }
        )
        .withColumns(
            {
                "operational_cost": _ratio("total_cost", "income"),
                "labor_gross_cost": _ratio("labor_cost", "labor_income"),
                "difference": F.col("labor_income") - F.col("labor_cost"),
            }
        )
        .withColumns(
            {
                "operational_profit": 1 - F.col("operational_cost"),
                "labor_gross_profit": 1 - F.col("labor_gross_cost"),
                "net_result": F.col("difference") - F.col("expenses"),
            }
        )
    )


def _sum_of(source: str, into: str) -> Column:
    return total_or_zero(F.when(F.col("source") == source, F.col("amount"))).alias(into)


def monthly_profit(
    ledger: DataFrame, expense_report: DataFrame, first: Day | None = None, last: Day | None = None
) -> DataFrame:
    """One row per month: category sums and the results derived from them.

    All aggregates are additive: each task hands on one partial row per month and
    account, whatever the size of the ledger.
    """
    rows = ledger if first is None else ledger.where(within(first, last))
    sums = (
        classified_sums(rows, expense_report, year_month=year_month("date"))
        .groupBy("year_month")
        .agg(
            _sum_of("income", "income"),
            _sum_of("material_cost", "material_cost"),
            _sum_of("labor_cost", "labor_cost"),
            _sum_of("expense", "expenses"),
        )
    )
    named = sums.withColumns(
        {"period": F.date_format("year_month", "yyyy-MM"), "year_quarter": quarter_label("year_month")}
    )
    return with_results(named)


def quarterly_profit(monthly: DataFrame) -> DataFrame:
    """Months summed to quarters, the ratios taken again from the sums."""
    return with_results(monthly.groupBy("year_quarter").agg(*[F.sum(c).alias(c) for c in SUMMED]))


def income_by_customer(ledger: DataFrame, expense_report: DataFrame) -> DataFrame:
    known = ledger.where(F.col("customer").isNotNull())
    sums = classified_sums(
        known, expense_report, year_quarter=quarter_label("date"), customer=F.col("customer")
    ).where("source = 'income'")
    return sums.groupBy("year_quarter", "customer").agg(F.sum("amount").alias("amount")).where("amount <> 0")


def expense_by_account(ledger: DataFrame, expense_report: DataFrame) -> DataFrame:
    sums = classified_sums(ledger, expense_report, year_quarter=quarter_label("date"))
    return (
        sums.where("source = 'expense' and amount <> 0")
        .select("year_quarter", "account", "amount")
        .orderBy(F.desc_nulls_last("amount"))
    )


def account_distribution(ledger: DataFrame, first: Day, last: Day) -> DataFrame:
    """Count and sum per transaction type and day for four account categories."""
    categories = (
        (OPERATIONAL_INCOME, "operational_income"),
        (MATERIAL_INCOME, "materials_income"),
        (DIRECT_LABOR, "direct_labor"),
        (DIRECT_MATERIAL, "direct_material"),
    )
    hits = F.array(*[F.when(F.col("account").rlike(p), F.lit(label)) for p, label in categories])
    return (
        ledger.where(within(first, last))
        .select("type", "date", F.coalesce("amount", F.lit(0)).alias("amount"),
                F.explode(F.array_compact(hits)).alias("account"))
        .groupBy("type", "date", "account")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
        .withColumns({"year_month": year_month("date"), "year_quarter": quarter_label("date")})
    )


def account_overview(distribution: DataFrame) -> DataFrame:
    return (
        distribution.groupBy("type", "account")
        .agg(F.sum("n").alias("count"), F.sum("amount").alias("amount"))
        .orderBy("account", "type")
    )


def summary(df: DataFrame, columns: Sequence[str] = MEASURES) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of nulls of each column.

    Meant for result tables such as months or quarters; quartiles interpolate
    linearly between neighbours.
    """
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot([], list(columns), "measure", "value")
    exact = F.col("value").cast("decimal(38,10)")
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        long.groupBy("measure")
        .agg(
            F.min("value").alias("minimum"),
            quartiles.alias("q"),
            F.sum(exact).cast("double").alias("s"),
            F.count("value").alias("n"),
            F.max("value").alias("maximum"),
            F.count_if(F.col("value").isNull()).alias("missing"),
        )
        .select(
            "measure",
            "minimum",
            F.col("q")[0].alias("first_quartile"),
            F.col("q")[1].alias("median"),
            F.try_divide("s", "n").alias("mean"),
            F.col("q")[2].alias("third_quartile"),
            "maximum",
            "missing",
        )
    )


def _is_invoiced() -> Column:
    """Invoice lines with a known amount, receivables aside."""
    return (F.col("type") == "Invoice") & F.col("amount").isNotNull() & ~matches("account", "Receiva")


def _is_expensed(own_company: str | None) -> Column:
    """Project cost lines, without the company's own and without unknown customers."""
    cost = matches("account", COST_ACCOUNTS) & F.col("customer").isNotNull()
    return cost if own_company is None else cost & ~matches("customer", own_company)


def invoiced_rows(ledger: DataFrame, first: Day, last: Day) -> DataFrame:
    return ledger.where(within(first, last) & _is_invoiced())


def period_invoiced(ledger: DataFrame, first: Day, last: Day) -> DataFrame:
    return invoiced_rows(ledger, first, last).groupBy("customer").agg(F.sum("amount").alias("amount"))


def expensed_rows(ledger: DataFrame, first: Day, last: Day, own_company: str | None = None) -> DataFrame:
    return ledger.where(within(first, last) & _is_expensed(own_company))


def period_expensed(
    ledger: DataFrame, first: Day, last: Day, own_company: str | None = None, skip_missing: bool = False
) -> DataFrame:
    amount = total("amount", skip_missing)
    return expensed_rows(ledger, first, last, own_company).groupBy("customer").agg(amount.alias("amount"))


def period_total(by_customer: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Grand total of a by-customer table, zero when the table is empty."""
    known = F.count(F.lit(1)) == F.count("amount")
    amount = total_or_zero("amount")
    return by_customer.agg((amount if skip_missing else F.when(known, amount)).alias("amount"))


def period_result(ledger: DataFrame, first: Day, last: Day, own_company: str | None = None) -> DataFrame:
    """Invoiced against expensed per customer; what is missing or unknown counts as zero.

    Both sides are conditional sums of one pass over the ledger, so no join is
    needed to bring them together.
    """
    invoiced = F.coalesce(_is_invoiced(), F.lit(False))
    expensed = _is_expensed(own_company)
    return (
        ledger.where(within(first, last) & (invoiced | expensed))
        .groupBy("customer")
        .agg(
            F.coalesce(total_where(invoiced, "amount"), F.lit(0)).alias("amount_invoiced"),
            F.coalesce(total_where(expensed, "amount"), F.lit(0)).alias("amount_expensed"),
        )
    )


def audit_extract(
    ledger: DataFrame,
    first: Day,
    last: Day,
    account: str,
    type: str | None = None,
    zero_missing: bool = True,
) -> DataFrame:
    """Ledger lines of a fixed window by account pattern and, if wanted, type."""
    rows = ledger.where(within(first, last) & matches("account", account))
    if type is not None:
        rows = rows.where(F.col("type") == type)
    return rows.fillna(0, ["amount"]) if zero_missing else rows
