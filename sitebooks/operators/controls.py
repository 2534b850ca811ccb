"""Subcontract budgets against payments, project control, rollups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (
    if_known,
    joined,
    map_columns,
    matches,
    nth_piece,
    repeated_text,
    total,
    total_or_null,
    total_where,
)
from .ledger import alias_matching

# Payment types, and the material share of a labor budget by service.
EXPENSE, SUBCONTRACT, HOURLY = "Expense", "Subcontract", "Hourly Labor"
MATERIAL_SHARE = (
    ("Dryw", "0.40"),
    ("Fram", "0.60"),
    ("Stuc", "0.12"),
    ("Inst", "0.20"),
    ("Fini", "0.15"),
    ("Pain", "0.20"),
)
# Fixed value: cost of one logged hour.
HOUR_RATE = 21
RATE = "decimal(4,2)"
COMPLETION = "decimal(20,18)"


def _in_open(df: DataFrame, open_projects: DataFrame) -> DataFrame:
    """Keep open projects of a frame that is already summed per project."""
    return joined(df, open_projects.select("project").distinct(), ["project"], "left_semi")


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def project_filter_counts(subcontracts: DataFrame, open_projects: DataFrame) -> DataFrame:
    """Subcontracts per open project and name."""
    counts = subcontracts.groupBy("project", F.trim("subcontract_name").alias("subcontract_name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _in_open(counts, open_projects)


def payments_by_kind(
    payments: DataFrame, interest: str, names: Sequence[tuple[str, str]], skip_missing: bool = False
) -> DataFrame:
    """Labor and materials paid per project and service."""
    kind = F.col("transaction_type")
    return (
        payments.where(matches("project", interest))
        .groupBy(alias_matching(F.col("project"), names).alias("project"), F.col("services").alias("service"))
        .agg(
            total_where(kind != EXPENSE, "amount_paid", skip_missing).alias("labor"),
            total_where(kind == EXPENSE, "amount_paid", skip_missing).alias("materials"),
        )
    )


def payment_details(payments: DataFrame, interest: str, names: Sequence[tuple[str, str]]) -> DataFrame:
    """The payments of interest line by line, each labor or materials; an unknown type stays unknown."""
    kind = F.col("transaction_type")
    return payments.where(matches("project", interest)).select(
        F.col("payment_date").alias("date"),
        alias_matching(F.col("project"), names).alias("project"),
        F.col("services").alias("service"),
        F.trim("subcontract_name").alias("subcontract_name"),
        F.col("subcontract").alias("subcontract_id"),
        if_known(kind == EXPENSE, F.lit("Materials"), F.lit("Labor")).alias("type"),
        F.col("amount_paid").alias("amount"),
    )


def _listed(subcontracts: DataFrame, interest: str, names: Sequence[tuple[str, str]]) -> DataFrame:
    return subcontracts.where(matches("project", interest) & ~matches("subcontract_name", "Old")).select(
        alias_matching(F.col("project"), names).alias("project"),
        "service",
        F.trim("subcontract_name").alias("subcontract_name"),
        F.col("contract_amount").alias("subcontract_amount"),
        "budget_days",
    )


def subcontract_table(subcontracts: DataFrame, interest: str, names: Sequence[tuple[str, str]]) -> DataFrame:
    """The subcontracts of interest that are not old ones, by project."""
    return _listed(subcontracts, interest, names).orderBy(F.asc_nulls_last("project"))


def subcontract_vs_payments(
    subcontracts: DataFrame, paid: DataFrame, interest: str, names: Sequence[tuple[str, str]]
) -> DataFrame:
    """Subcontracts of interest next to what was paid for their project and service."""
    listed = _listed(subcontracts, interest, names)
    return joined(listed.distinct(), paid, ["project", "service"])


def open_project_book(
    subcontracts: DataFrame, payments: DataFrame, interest: str, names: Sequence[tuple[str, str]], skip_missing: bool = False
) -> dict[str, DataFrame]:
    """The four tables of the open projects' workbook."""
    paid = payments_by_kind(payments, interest, names, skip_missing)
    return {
        "consolid": subcontract_vs_payments(subcontracts, paid, interest, names),
        "detail_payments": payment_details(payments, interest, names),
        "consolid_payments": paid,
        "subct_raw": subcontract_table(subcontracts, interest, names),
    }


def _paid_by_type(payments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Payments per key: labor (subcontract and hourly) and materials; unknown sums count as zero."""

    def paid(kind: str) -> Column:
        summed = total_where(F.col("transaction_type") == kind, "amount_paid", skip_missing=False)
        return F.coalesce(summed, F.lit(0))

    return payments.groupBy(*keys).agg(
        (paid(SUBCONTRACT) + paid(HOURLY)).alias("labor_paid"), paid(EXPENSE).alias("materials_paid")
    )


def project_analysis(
    payments: DataFrame,
    contracts: DataFrame,
    open_projects: DataFrame,
    completion: float = 1,
    closed: str | None = None,
) -> DataFrame:
    """Budget against payments per open project and subcontract."""
    still_open = open_projects if closed is None else open_projects.where(~matches("project", closed))
    known = payments.where(F.col("project").isNotNull())
    paid = _paid_by_type(known, ["project", "services", "subcontract", "subcontract_name"])
    budget = contracts.select("project", "subcontract_id", F.coalesce("contract_amount", F.lit(0)).alias("labor_budget"))
    full = joined(
        _in_open(paid, still_open), budget, [("subcontract", "subcontract_id"), "project"]
    ).withColumnRenamed("subcontract", "subct_id")
    share = F.when(F.lit(False), F.lit(None).cast(RATE))
    for name, rate in MATERIAL_SHARE:
        share = share.when(F.col("subcontract_name").rlike(name), F.lit(rate).cast(RATE))
    done = F.lit(completion).cast(COMPLETION)
    full = full.withColumns(
        {
            "completion": F.lit(float(completion)),
            "accrued_labor": done * F.col("labor_budget"),
            "materials_budget": F.col("labor_budget") * share,
        }
    ).withColumn("accrued_materials", done * F.col("materials_budget"))
    return full.select(
        F.initcap(F.trim(F.substring("project", 1, 12))).alias("short_name"),
        "project",
        F.regexp_substr("subct_id", F.lit(r"\d+")).alias("subct_id"),
        F.trim("subcontract_name").alias("subcontract_name"),
        "completion",
        "labor_budget",
        "accrued_labor",
        "labor_paid",
        (1 - _share(F.col("labor_paid"), F.col("accrued_labor"))).alias("labor_ratio"),
        "materials_budget",
        "accrued_materials",
        "materials_paid",
        (1 - _share(F.col("materials_paid"), F.col("accrued_materials"))).alias("materials_ratio"),
    )


def project_analysis_summary(analysis: DataFrame, sale_prices: DataFrame | None = None) -> DataFrame:
    """Realised cost per project and service; result and return once a sale price is known."""
    rows = analysis.select(
        "project",
        F.col("subcontract_name").alias("service"),
        (F.col("labor_paid") + F.col("materials_paid")).alias("cost_realised"),
        F.col("labor_paid").alias("labor_cost"),
        F.col("materials_paid").alias("material_cost"),
    )
    if sale_prices is None:
        priced = rows.withColumn("sale_price", F.lit(None).cast("decimal(18,2)"))
    else:
        priced = joined(rows, sale_prices.select("project", "service", "sale_price"), ["project", "service"])
    return priced.withColumns(
        {
            "result": F.col("sale_price") - F.col("cost_realised"),
            "return_share": 1 - _share(F.col("cost_realised"), F.col("sale_price")),
        }
    )


def change_orders(orders: DataFrame, analysis: DataFrame) -> DataFrame:
    """Change orders, with a readable number, of the projects in an analysis (open ones with payments)."""
    number = F.concat(F.lit("CO000"), F.coalesce(F.col("change_order_number").cast("string"), F.lit("NA")))
    rows = orders.withColumn("co_num", number).drop("change_order_number")
    return joined(rows, analysis.select("project").distinct(), ["project"], "left_semi")


def time_log_totals(time_logs: DataFrame, open_projects: DataFrame) -> DataFrame:
    """Hours, first day and cost per open project and service, maintenance aside.

    The logs of all workers of a service are summed, so that joining them to a
    project control row never multiplies it.
    """
    service = F.trim(nth_piece("controlabor", "[-]", 0))
    sums = (
        time_logs.where(~matches("controlabor", "Maintenance"))
        .groupBy(F.trim("project_name").alias("project"), service.alias("servicio"))
        .agg(total_or_null("duration").alias("hours_registered"), F.min("task_date").alias("start_date"))
    )
    return _in_open(sums, open_projects).withColumn("estimated_cost", F.col("hours_registered") * HOUR_RATE)


def project_control(
    payments: DataFrame,
    controls: DataFrame,
    time_logs: DataFrame,
    open_projects: DataFrame,
    as_of: dt.date,
    completion: float = 1,
) -> DataFrame:
    """Bid, budgets, payments, days, hours and profits per open project and labor control."""
    known = payments.where(F.col("project").isNotNull())
    keys = ["project", "subcontract", "subcontract_name"]
    paid = _in_open(_paid_by_type(known, keys), open_projects)
    full = joined(
        paid,
        _in_open(controls.drop("start_date"), open_projects),
        ["project", ("subcontract", "controlabor_id"), ("subcontract_name", "controlabor_name")],
    )
    rows = map_columns(
        full.where(~matches("subcontract_name", "Maintenance")).withColumnsRenamed(
            {"subcontract_name": "servicio", "labor_amount": "labor_budget", "materials": "materials_budget"}
        ),
        F.trim,
    )
    logged = joined(rows, time_log_totals(time_logs, open_projects), ["project", "servicio"])
    done = F.lit(completion).cast(COMPLETION)
    return logged.select(
        "project",
        "servicio",
        "start_date",
        "bid_price",
        F.lit(as_of).alias("revision"),
        F.lit(float(completion)).alias("completion"),
        "labor_budget",
        (F.col("labor_budget") * done).alias("labor_budget_completed"),
        "labor_paid",
        (F.col("labor_paid") - F.col("labor_budget") * done).alias("labor_over_budget"),
        "materials_budget",
        (F.col("materials_budget") * done).alias("materials_budget_completed"),
        "materials_paid",
        (F.col("materials_paid") - F.col("materials_budget") * done).alias("materials_over_budget"),
        "budget_days",
        "used_days",
        F.coalesce("hours_registered", F.lit(0)).alias("hours_registered"),
        (F.col("budget_days") - F.col("used_days")).alias("remaining_days"),
        (F.col("bid_price") - F.col("materials_budget") - F.col("labor_budget")).alias("expected_profit"),
        (F.col("bid_price") - F.col("labor_paid") - F.col("materials_paid")).alias("current_profit"),
        ((F.col("bid_price") - F.col("materials_paid")) * done - F.col("labor_paid")).alias("real_profit"),
    )


def project_control_short(control: DataFrame) -> DataFrame:
    return control.select(
        "project", "servicio", "start_date", "bid_price", "completion",
        "labor_budget", "labor_paid", "materials_budget", "materials_paid",
    )


def paid_last_week(payments: DataFrame, open_projects: DataFrame, as_of: dt.date, days: int = 8) -> DataFrame:
    recent = payments.where(F.col("payment_date") > F.date_sub(F.lit(as_of), days))
    sums = recent.groupBy(
        "project", F.trim("subcontract_name").alias("subcontract_name"), "transaction_type"
    ).agg(total_or_null("amount_paid").alias("amount_paid"))
    return _in_open(sums, open_projects)


def labor_paid_update(
    payments: DataFrame, open_projects: DataFrame, project: str, subcontract: str, skip_missing: bool = False
) -> DataFrame:
    """Labor paid of a project by labor control."""
    rows = payments.where(
        matches("project", project)
        & (F.col("transaction_type") != EXPENSE)
        & matches("subcontract_name", subcontract)
    )
    sums = rows.groupBy("project", "subcontract_name").agg(total("amount_paid", skip_missing).alias("amount_paid"))
    return _in_open(sums, open_projects)


def time_log_start(time_logs: DataFrame, project: str) -> DataFrame:
    return time_logs.where(matches("project_name", project)).orderBy(F.asc_nulls_last("task_date"))


def project_services(export: DataFrame) -> DataFrame:
    """The services of each project with their number of rows, one row per service."""
    named = export.select(F.trim("project").alias("project"), F.trim("servicio").alias("servicio"))
    return named.groupBy("project", "servicio").agg(F.count(F.lit(1)).alias("n"))


def project_rollup(export: DataFrame) -> DataFrame:
    """One row per project: sums, service list, mean completion of at most one.

    Services are counted per project first, so the list text is built from
    distinct services whatever the number of rows.
    """
    tidy = map_columns(export, F.trim)
    added = [
        f.name for f in tidy.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name != "completion_percent"
    ]
    completion = F.col("completion_percent").cast("decimal(28,6)")
    per_service = tidy.groupBy("project", "servicio").agg(
        F.count(F.lit(1)).alias("n"),
        total_or_null(completion).alias("completion_percent"),
        *[total_or_null(c).alias(c) for c in added],
    )
    mean = _share(total_or_null("completion_percent"), F.sum("n"))
    return per_service.groupBy("project").agg(
        repeated_text("servicio", "n", ", ").alias("services"),
        if_known(mean > 1, F.lit(1.0), mean).alias("completion_percent"),
        *[total_or_null(c).alias(c) for c in added],
    )
