"""Project costing: cash in and out per project, statuses, cost breakdowns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    append_total,
    containing_values,
    drop_first_match,
    if_known,
    joined,
    matches,
    matching_values,
    nth_piece,
    separate,
    total,
    total_or_null,
    total_or_zero,
    with_clues,
)
from ..session import kept
from .ledger import (
    COST_ACCOUNTS,
    DIRECT_LABOR,
    DIRECT_MATERIAL,
    SHORT_CONCEPTS,
    alias_equal,
    alias_matching,
    cost_concept,
)
from .receivables import INCOME_ACCOUNTS

# Project short names have nine characters; account levels split at these.
SHORT_NAME = 9
LEVELS = "[.?:]"
# Class names as reports spell them.
CLASS_NAMES = {"Drywall Installation": "Drywall / Finish", "Reapirs / Install": "Repairs / Installation"}


def _is_cost() -> Column:
    return matches("account", COST_ACCOUNTS)


def _is_income() -> Column:
    return (F.col("type") == "Invoice") & matches("account", INCOME_ACCOUNTS)


def project_expenses(ledger: DataFrame, clues: Sequence[str]) -> DataFrame:
    """Cost lines of the projects a clue finds, for all clues in one scan."""
    return with_clues(ledger.where(_is_cost()), "customer", clues)


def project_incomes(ledger: DataFrame, clues: Sequence[str]) -> DataFrame:
    """Invoiced income lines of the projects a clue finds."""
    return with_clues(ledger.where(_is_income()), "customer", clues)


def expenses_daily(expenses: DataFrame) -> DataFrame:
    return expenses.groupBy("clue", "customer", "date").agg(total_or_null("amount").alias("amount"))


def grouped_expenses(expenses: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Cost per account, split into cost or expense, account group and detail."""
    sums = expenses.groupBy("clue", "account").agg(total("amount", skip_missing).alias("amount"))
    split = separate(sums, "account", ["main", "second", "third"], LEVELS)
    second = if_known(F.col("main") == "Cost of Goods Sold", F.col("second"), F.col("main"))
    kind = F.when(second.rlike("Direct"), "Cost").when(second.rlike("Indirect"), "Expense")
    return split.withColumns({"second": second, "main": kind})


def grouped_incomes(incomes: DataFrame) -> DataFrame:
    sums = incomes.groupBy("clue", "account", "num").agg(total_or_null("amount").alias("amount"))
    return separate(sums, "account", ["main", "second"])


def expenses_level(expenses: DataFrame, skip_missing: bool = False) -> DataFrame:
    sums = expenses.groupBy("clue", "date", "account", "class").agg(total("amount", skip_missing).alias("amount"))
    return separate(sums, "account", ["main", "second", "third"], LEVELS).drop("third")


def incomes_level(incomes: DataFrame, skip_missing: bool = False) -> DataFrame:
    sums = incomes.groupBy("clue", "date", "account", "num").agg(total("amount", skip_missing).alias("amount"))
    split = separate(sums, "account", ["main", "class"])
    return split.withColumnRenamed("num", "second")


def vendor_client(ledger: DataFrame, vendor: str, project: str) -> DataFrame:
    rows = ledger.where(matches("name", vendor) & matches("customer", project))
    return rows.orderBy(F.desc_nulls_last("date"))


def invoices_by_project(invoices: DataFrame, clue: str) -> DataFrame:
    return invoices.where(matches("project_name", clue))


def type_counts(ledger: DataFrame) -> DataFrame:
    """Number of ledger rows per type, with a total."""
    counts = ledger.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return append_total(counts, "type").orderBy(F.col("type") == "Total", F.desc("n"))


# -- recent projects and their cash flow -------------------------------------------


def recent_projects(ledger: DataFrame, as_of: dt.date, months: int = 1) -> DataFrame:
    """Customers active in the last months: rows, volume, project, short name, file key."""
    since = F.add_months(F.lit(as_of), -months)
    active = (
        ledger.where(F.col("customer").isNotNull() & (F.col("date") >= since))
        .groupBy("customer")
        .agg(F.count(F.lit(1)).alias("n"), total_or_zero("amount").alias("volume"))
    )
    named = separate(active, "customer", ["customer", "project"]).withColumn(
        "project", F.coalesce("project", "customer")
    )
    short = F.substring("project", 1, SHORT_NAME)
    file = F.concat(drop_first_match(F.lower(short), " ", "_"), F.lit(".xlsx"))
    return named.withColumns({"project_name": F.trim(short), "file_name": drop_first_match(file, " ")})


def recent_project_names(recent: DataFrame) -> DataFrame:
    return recent.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_name")


def recent_volume(ledger: DataFrame, as_of: dt.date, days: int = 10) -> DataFrame:
    """Customers with movement in the last days and a known sum other than zero."""
    since = F.date_sub(F.lit(as_of), days)
    return (
        ledger.where((F.col("date") >= since) & F.col("customer").isNotNull())
        .groupBy("customer")
        .agg(F.count(F.lit(1)).alias("n"), total_or_null("amount").alias("amount"))
        .where("amount <> 0")
        .orderBy(F.desc("amount"), "customer")
    )


def _directed(rows: DataFrame, out: str, into: str) -> DataFrame:
    """Each cost row as ``out``, each income row as ``into`` (both, if it is both).

    The filter says the same as the array; it can go below the joins that the rows come from.
    """
    hits = F.array(F.when(_is_cost(), F.lit(out)), F.when(_is_income(), F.lit(into)))
    wanted = rows.where(_is_cost() | _is_income())
    return wanted.withColumn("direction", F.explode(F.array_compact(hits)))


def _signed(direction_out: str) -> Column:
    return F.when(F.col("direction") == direction_out, -F.col("amount")).otherwise(F.col("amount"))


def _of_projects(rows: DataFrame, projects: DataFrame, regex: bool = False) -> DataFrame:
    """Rows whose customer contains the short name of a project, or fits it as a regex, once per project.

    Unknown customers belong to no project and stay out of the join.  The rows are read for their distinct
    customers and for the join, so they are written first.
    """
    names = projects.select(F.col("project_name").alias("clue")).distinct()
    known = kept(rows.where(F.col("customer").isNotNull()))
    if regex:
        pairs = matching_values(known, "customer", kept(names), "clue")
    else:
        pairs = containing_values(known, "customer", names, "clue")
    return known.join(pairs, "customer")


def project_cashflow(ledger: DataFrame, projects: DataFrame, regex: bool = False) -> DataFrame:
    """Cost lines (negative, OUT) and income lines (IN) of every project.

    With ``regex`` the project names are a table of regexes.
    """
    flow = _of_projects(_directed(ledger, "OUT", "IN"), projects, regex)
    return flow.withColumn("amount", _signed("OUT")).withColumnRenamed("clue", "project")


def project_status(ledger: DataFrame, recent: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Recent projects with their net cash.

    The ledger is summed per customer before customers are matched to projects.
    """
    flow = _directed(ledger, "OUT", "IN").withColumn("amount", _signed("OUT"))
    by_customer = flow.groupBy("customer").agg(total("amount", skip_missing).alias("amount"))
    net = _of_projects(by_customer, recent)
    files = recent.select(F.col("project_name").alias("clue"), "file_name").distinct()
    # one file per short name: the first in order, should two spellings share it
    files = files.groupBy("clue").agg(F.min("file_name").alias("file_name"))
    status = (
        joined(net, files, ["clue"], "inner")
        .groupBy("file_name")
        .agg(total("amount", skip_missing).alias("status"))
    )
    return joined(recent, status, ["file_name"]).drop("n")


def cashflow_levels(ledger: DataFrame, projects: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Cash flow per day and account level: outflow negative, inflow by invoice."""
    keys = ["date", "account", "class", "num", "direction"]
    # a sum per customer, day and invoice is about a line: lines meet the projects, sums are by project
    lines = _directed(ledger, "outflow", "inflow").select(
        "customer",
        "date",
        "account",
        F.when(F.col("direction") == "outflow", F.col("class")).alias("class"),
        F.when(F.col("direction") == "inflow", F.col("num")).alias("num"),
        "direction",
        "amount",
    )
    by_project = (
        _of_projects(lines, projects)
        .groupBy("clue", *keys)
        .agg(total("amount", skip_missing).alias("amount"))
    )
    is_out = F.col("direction") == "outflow"
    class_name = F.when(is_out, F.col("class")).otherwise(nth_piece("account", ":", 1))
    return by_project.select(
        "date",
        F.when(is_out, nth_piece("account", LEVELS, 0)).otherwise(nth_piece("account", ":", 0)).alias("main"),
        F.when(is_out, nth_piece("account", LEVELS, 1)).otherwise(F.col("num")).alias("second"),
        alias_equal(class_name, CLASS_NAMES).alias("class"),
        _signed("outflow").alias("amount"),
        "direction",
        F.col("clue").alias("project"),
    )


def cashflow_consolidated(levels: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Merged cash flow with project names and cost concepts."""
    second = F.coalesce("second", "main")
    return levels.withColumns(
        {
            "project": alias_equal(F.col("project"), names, keep_unlisted=False),
            "second": second,
            "concept": cost_concept(second),
        }
    )


def cashflow_sums(consolidated: DataFrame, by_date: bool, skip_missing: bool = False) -> DataFrame:
    keys = (["date"] if by_date else []) + ["project", "concept", "class", "direction"]
    sums = consolidated.groupBy(*keys).agg(total("amount", skip_missing).alias("amount"))
    return sums.orderBy(*[F.asc_nulls_last(k) for k in ("project", "direction", "concept", "class")])


def cashflow_by_project(consolidated: DataFrame, skip_missing: bool = False) -> DataFrame:
    sums = consolidated.groupBy("project").agg(total("amount", skip_missing).alias("amount"))
    return append_total(sums, "project")


# -- cost breakdowns ---------------------------------------------------------------


def _cost_rows(
    ledger: DataFrame,
    interest: str | None,
    names: Sequence[tuple[str, str]],
    first: dt.date | str | None,
    last: dt.date | str | None,
) -> DataFrame:
    """Cost lines with their project's name and their concept."""
    rows = ledger.where(_is_cost())
    if interest is not None:
        rows = rows.where(matches("customer", interest))
    if first is not None:
        rows = rows.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    project = nth_piece("customer", ":", 1)
    if names:
        project = alias_matching(project, names)
    return rows.withColumns({"project": project, "concept": cost_concept(F.col("account"))})


def project_costs(
    ledger: DataFrame,
    interest: str | None = None,
    names: Sequence[tuple[str, str]] = (),
    first: dt.date | str | None = None,
    last: dt.date | str | None = None,
    skip_missing: bool = False,
) -> DataFrame:
    """Cost per project, class and concept: projects of interest, or all in a period."""
    rows = _cost_rows(ledger, interest, names, first, last)
    return rows.groupBy("project", "class", "concept").agg(total("amount", skip_missing).alias("amount"))


def project_cost_lines(
    ledger: DataFrame,
    interest: str | None = None,
    names: Sequence[tuple[str, str]] = (),
    first: dt.date | str | None = None,
    last: dt.date | str | None = None,
) -> DataFrame:
    """The lines behind ``project_costs``, by project."""
    rows = _cost_rows(ledger, interest, names, first, last)
    lines = rows.select("date", "project", "class", "concept", "amount")
    return lines.orderBy(F.asc_nulls_last("project"))


def phase_costs(expenses: DataFrame, cut: dt.date | str, classes: Mapping[str, str]) -> DataFrame:
    """Cost lines by day with their concept, class name and the phase a cut day puts them in."""
    early = F.col("date") <= F.lit(cut).cast("date")
    lines = expenses.select("clue", "date", "account", "class", "amount").withColumns(
        {
            "concept": cost_concept(F.col("account"), SHORT_CONCEPTS),
            "phase": if_known(early, F.lit("1st"), F.lit("2nd")),
            "class": alias_equal(F.col("class"), classes),
        }
    )
    return lines.orderBy(F.asc_nulls_last("date"))


def prior_buckets(
    ledger: DataFrame, account: str, cut: str, end: str, skip_missing: bool = False
) -> DataFrame:
    """Sum per name before and after a cut day for accounts that fit, with a total."""
    early = F.col("date") < F.lit(cut).cast("date")
    bucket = if_known(early, F.lit(f"Prior to {cut}"), F.lit(f"Prior to {end}"))
    sums = (
        ledger.where(matches("account", account))
        .groupBy("name", bucket.alias("date_reference"))
        .agg(total("amount", skip_missing).alias("amount"))
    )
    return append_total(sums, "name")


def invoiced_by_service(ledger: DataFrame, clues: Sequence[str]) -> DataFrame:
    """Invoiced per project, invoice and service, with a total per clue."""
    rows = ledger.where(
        matches("type", "Invoice") & matches("split", "Accounts R") & F.col("account").isNotNull()
    )
    sums = (
        with_clues(rows, "customer", clues)
        .groupBy(
            "clue",
            nth_piece("customer", ":", 1).alias("project"),
            "num",
            nth_piece("account", ":", 1).alias("service"),
        )
        .agg(total_or_null("amount").alias("amount"))
    )
    return append_total(sums, "project", by=["clue"])


def assumed_costs(ledger: DataFrame, clues: Sequence[str], skip_missing: bool = False) -> DataFrame:
    """Direct labor and material per project and class, with a total per clue."""
    account = F.col("account")
    source = F.when(account.rlike(DIRECT_LABOR), "labor").when(account.rlike(DIRECT_MATERIAL), "materials")
    rows = ledger.withColumn("source", source).where(F.col("source").isNotNull())
    sums = (
        with_clues(rows, "customer", clues)
        .groupBy("clue", nth_piece("customer", ":", 1).alias("project"), "source", "class")
        .agg(total("amount", skip_missing).alias("amount"))
    )
    return append_total(sums, "project", by=["clue"])
