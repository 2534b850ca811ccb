"""Expense matrix, budget, vendors."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    first_day_of_month,
    in_windows,
    joined,
    last_day_of_previous_month,
    month_label,
    nth_piece,
    separate,
    sorted_text,
    total_or_zero,
    year_month,
)
from ..session import kept
from .ledger import classified_sums, expense_accounts

# Fixed value: the holding account that is left out of budgets.
UNSORTED_ACCOUNT = "Ask Accountant"
# Fixed value: what stands for a missing sub account in the matrix.
NO_SUB = "0"
# Fewer than this many empty months and at least this sum keep an account.
MOST_ZERO_MONTHS, LEAST_SUM = 3, 100
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
# Most month columns of a matrix: a wider range is a wrong date, not a report.
MOST_MONTHS = 1200


def month_labels(first: dt.date, last: dt.date) -> list[str]:
    """Labels of all months between two days, both included."""
    span = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return [f"{_MONTHS[m % 12]}_{m // 12}" for m in span]


def expense_rows(ledger: DataFrame, expense_report: DataFrame) -> DataFrame:
    """Ledger rows on expense accounts, unknown amounts as zero."""
    accounts = expense_accounts(expense_report)
    return joined(ledger.fillna(0, ["amount"]), accounts, ["account"], "left_semi")


def _month_sums(ledger: DataFrame, expense_report: DataFrame) -> DataFrame:
    sums = classified_sums(ledger, expense_report, year_month=year_month("date"))
    return sums.where("source = 'expense'").select("account", "year_month", "amount")


def _months_of(sums: DataFrame) -> list[str]:
    """Labels from the first to the last month that ``sums`` hold; one row comes back to the driver."""
    first, last, undated = sums.agg(
        F.min("year_month"), F.max("year_month"), F.count_if(F.col("year_month").isNull())
    ).first()
    if undated:
        raise ValueError("expenses without a date have no month column")
    if first is None:
        return []
    labels = month_labels(first, last)
    if len(labels) > MOST_MONTHS:
        raise ValueError(f"expenses from {first} to {last} make {len(labels)} months, more than {MOST_MONTHS}")
    return labels


def _by_month(sums: DataFrame, months: Sequence[str], *keys: str) -> DataFrame:
    """One column per month; months without expense are zero."""
    labelled = sums.withColumn("period", month_label("year_month"))
    cells = labelled.groupBy(*keys).pivot("period", list(months)) if months else labelled.groupBy(*keys)
    wide = cells.agg(F.sum("amount").alias("amount"))
    return wide.fillna(0, list(months)) if months else wide.select(*keys)


def vendor_months(ledger: DataFrame) -> DataFrame:
    """The ledger summed per month, account and name, with the last day of each: written once.

    Month sums and vendor lists need no more, so a budget reads the ledger one time.
    """
    sums = ledger.groupBy(year_month("date").alias("__month"), "account", "name").agg(
        F.max("date").alias("date"), total_or_zero("amount").alias("amount")
    )
    return kept(sums.drop("__month"))


def account_vendor_names(expenses: DataFrame, since: dt.date | str) -> DataFrame:
    """The vendors of each main and sub account since a day, one row per vendor."""
    pairs = (
        expenses.where((F.col("date") >= F.lit(since).cast("date")) & (F.col("account") != UNSORTED_ACCOUNT))
        .select("account", F.coalesce("name", F.lit("-")).alias("name"))
        .distinct()
    )
    split = separate(pairs, "account", ["main_account", "sub_account"])
    return split.withColumn("sub_account", F.coalesce("sub_account", "main_account")).distinct()


def account_vendors(expenses: DataFrame, since: dt.date | str) -> DataFrame:
    """Sorted vendor list per main and sub account, with the number of vendors.

    Vendors are made distinct before they are listed, so the state of a list is
    its own result and not the rows behind it; where even that is too long for one text, take
    :func:`account_vendor_names`.  The number of vendors is the number of commas plus one, a comma inside
    a name included.
    """
    named = account_vendor_names(expenses, since)
    commas = F.sum(F.regexp_count("name", F.lit(",")))
    return named.groupBy("main_account", "sub_account").agg(
        sorted_text("name").alias("vendor"), (commas + F.count("name")).alias("number_vendors")
    )


def expense_matrix(
    ledger: DataFrame, expense_report: DataFrame, between: tuple[dt.date, dt.date] | None = None
) -> DataFrame:
    """Main and sub account by month; months without expense are zero.

    The month columns follow the data: a first pass over the month sums finds their range, so no row can fall
    outside.  ``between`` asks for the months between two days only: every account stays, with these columns.
    """
    split = separate(_month_sums(ledger, expense_report), "account", ["main_account", "sub_account"])
    sums = split.withColumn("sub_account", F.coalesce("sub_account", F.lit(NO_SUB))).where(
        F.col("main_account") != UNSORTED_ACCOUNT
    )
    if between is not None:
        return _by_month(sums, month_labels(*between), "main_account", "sub_account")
    sums = kept(sums)  # both the range of months and the matrix are taken from them
    return _by_month(sums, _months_of(sums), "main_account", "sub_account")


def _row_sum(columns: Sequence[str]) -> Column:
    added = F.lit(0).cast("decimal(28,2)")
    for c in columns:
        added = added + F.col(c)
    return added


def expense_budget(
    matrix: DataFrame, vendors: DataFrame, as_of: dt.date, without: Sequence[str] = (), window: int = 3
) -> DataFrame:
    """Average month of last year, this year's months, vendors.

    An account stays when fewer than three of the months after ``as_of`` minus
    ``window`` months are zero and those months, plus the number of zeros, sum to
    100 or more.
    """
    last_year = [c for c in matrix.columns if c.endswith(f"_{as_of.year - 1}")]
    this_year = [c for c in matrix.columns if c.endswith(f"_{as_of.year}")]
    start = as_of.year * 12 + as_of.month - window  # zero-based month after the window start
    observed = [
        c for c in month_labels(dt.date(start // 12, start % 12 + 1, 1), as_of) if c in this_year
    ]
    complete = matrix.select(
        "main_account",
        F.when(F.col("sub_account") == NO_SUB, F.col("main_account"))
        .otherwise(F.col("sub_account"))
        .alias("sub_account"),
        F.try_divide(_row_sum(last_year).cast("double"), F.lit(12.0)).alias("last_year_average"),
        *this_year,
    )
    listed = joined(complete, vendors, ["main_account", "sub_account"]).where(F.col("vendor").isNotNull())
    zeros = sum((F.col(c) == 0).cast("int") for c in observed)
    kept = listed.where((zeros < MOST_ZERO_MONTHS) & (_row_sum(observed) + zeros >= LEAST_SUM))
    # the test is by sub account name alone
    names = kept.select("sub_account").where(~F.col("sub_account").isin(*without)).distinct()
    return joined(listed, names, ["sub_account"], "left_semi")


def expense_by_month(matrix: DataFrame) -> DataFrame:
    """Main account by month as a long table."""
    months = [c for c in matrix.columns if c not in ("main_account", "sub_account")]
    main = matrix.groupBy("main_account").agg(*[F.sum(c).alias(c) for c in months])
    return main.unpivot("main_account", months, "period", "amount")


def account_zoom(ledger: DataFrame, expense_report: DataFrame) -> DataFrame:
    """Full account by month with the row total, the account split into three levels."""
    sums = kept(_month_sums(ledger, expense_report).where(nth_piece("account", ":", 0) != UNSORTED_ACCOUNT))
    months = _months_of(sums)
    wide = _by_month(sums, months, "account")
    zoomed = wide.withColumn("all_period_sum", _row_sum(months)).orderBy("account", F.desc("all_period_sum"))
    return separate(zoomed, "account", ["main_account", "sub_account", "spec_account"])


def new_vendors(expenses: DataFrame, since: dt.date | str) -> DataFrame:
    """Expense rows of vendors not seen up to the first day of the previous month.

    A row can only fall into the window of its own month, so no range join is
    needed: the day a vendor (or an account of that name) was first seen decides.
    Windows end one month after the last day of the previous month, which drops
    the last days after a shorter month.  ``since`` bounds the start of the
    previous month.
    """
    first_of_month = first_day_of_month("date")
    initial = F.add_months(first_of_month, -1)
    window_end = F.add_months(last_day_of_previous_month("date"), 1)
    known = expenses.where(F.col("name").isNotNull() & F.col("account").isNotNull())
    # rows and first days are taken from the distinct lines, so the ledger is read once
    known = kept(known.select("date", "type", "name", "account", "amount").distinct())
    rows = (
        known.where((F.col("date") <= window_end) & (initial >= F.lit(since).cast("date")))
        .select("date", "type", "name", "account", "amount")
        .na.drop("any")
        .distinct()
    )
    # one small aggregate serves both look-ups: its shuffle is reused
    firsts = known.groupBy("name", "account").agg(F.min("date").alias("seen"))
    vendors = firsts.groupBy("name").agg(F.min("seen").alias("vendor_seen"))
    accounts = firsts.groupBy(F.col("account").alias("name")).agg(F.min("seen").alias("account_seen"))
    marked = joined(joined(rows, vendors, ["name"]), accounts, ["name"])

    def seen(column: str) -> Column:
        return F.coalesce(F.col(column) <= initial, F.lit(False))

    return (
        marked.withColumns(
            {
                "classic_vendor": seen("vendor_seen"),
                "classic_account": seen("account_seen"),
                "year_month": first_of_month,
            }
        )
        .where(~F.col("classic_vendor"))
        .drop("vendor_seen", "account_seen")
    )


def new_vendors_in(expenses: DataFrame, windows: DataFrame) -> DataFrame:
    """Expense rows of vendors that a window counts as new, for windows given as a table.

    ``windows`` has ``initial``, ``future_first`` and ``future_last``: a vendor is new to the window if no row up to
    ``initial`` has it.  Windows may overlap and have any length; days meet windows by buckets, and the first
    day of a vendor (or of an account of that name) decides, so no row is compared with another.
    """
    known = expenses.where(F.col("name").isNotNull() & F.col("account").isNotNull())
    # rows and first days are taken from the written lines, so the ledger is read once
    known = kept(known.select("date", "type", "name", "account", "amount"))
    wanted = windows.select("initial", "future_first", "future_last").na.drop("any").distinct()
    firsts = known.groupBy("name", "account").agg(F.min("date").alias("seen"))
    vendors = firsts.groupBy("name").agg(F.min("seen").alias("vendor_seen"))
    accounts = firsts.groupBy(F.col("account").alias("name")).agg(F.min("seen").alias("account_seen"))
    # rows meet their first days before windows repeat them; a vendor first seen up to the earliest ``initial``
    # is new to no window
    earliest = wanted.agg(F.min("initial")).scalar()
    seen = vendors.where(F.col("vendor_seen") > earliest).join(accounts, "name", "left")
    rows = known.na.drop("any").join(seen, "name").distinct()
    marked = in_windows(rows, "date", wanted, "future_first", "future_last")
    return marked.where(F.col("vendor_seen") > F.col("initial")).select(
        "initial", "future_first", "future_last", "date", "type", "name", "account", "amount",
        F.coalesce(F.col("account_seen") <= F.col("initial"), F.lit(False)).alias("classic_account"),
    )
