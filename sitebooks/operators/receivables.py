"""Receivables: ageing, statements, state of account, customer concentration."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    OrderedRows,
    append_total,
    append_total_to_rows,
    clean_names,
    containing_values,
    drop_first_match,
    first_day_of_month,
    if_known,
    in_changed_parts,
    joined,
    matches,
    matching_values,
    repeated_text,
    separate,
    serial_day,
    tidy_text,
    total_or_null,
    total_or_zero,
    with_clues,
)
from ..session import kept
from .ledger import alias_equal, alias_matching, first_hit

# Invoice lines that are income, and receivable accounts.
INCOME_ACCOUNTS = ".Operational|Material"
RECEIVABLE = "Receiv"
# Share expected from large invoices, and what counts as large.
LARGE_INVOICE, LARGE_SHARE = 6000, "0.25"


# Place of a row in its file, where the reader kept it.
SOURCE_LINE = "source_line"


# -- ageing and missing invoices ------------------------------------------------


def invoice_aging(invoices: DataFrame, as_of: dt.date, projects: Mapping[str, str] | None = None) -> DataFrame:
    """Open invoices with pending and paid shares, expected payment and age in days."""
    amount, open_balance = F.col("amount"), F.col("open_balance")
    pending = F.try_divide(open_balance.cast("double"), amount.cast("double"))
    share = (amount * F.lit(LARGE_SHARE).cast("decimal(3,2)")).cast("decimal(20,4)")
    aged = invoices.where(open_balance != 0).withColumns(
        {
            "pending_share": pending,
            "paid_share": 1 - pending,
            "expected_payment": if_known(amount > LARGE_INVOICE, share, open_balance.cast("decimal(20,4)")),
            "debt_days": F.datediff(F.lit(as_of), "date"),
            "project": alias_equal(F.trim("project_name"), projects or {}),
        }
    )
    return aged.drop("project_name")


def expected_by_project(aging: DataFrame) -> DataFrame:
    return aging.groupBy("project").agg(total_or_null("expected_payment").alias("expected_payment"))


def missing_in_other(
    left: DataFrame, right: DataFrame, on: Sequence[str | tuple[str, str]]
) -> DataFrame:
    """Rows of one system without a partner in the other; unknown keys match each other."""
    keys = [k if isinstance(k, str) else k[1] for k in on]
    return joined(left, right.select(*keys).distinct(), on, "left_anti")


def snapshot_delta(
    new: DataFrame, old: DataFrame, on: Sequence[str] = ("date", "name", "amount"), part: str | None = None
) -> DataFrame:
    """Rows of the new extract that the old one did not have.

    With ``part``, a column of ``on`` with few values such as the day, rows of parts whose keys are the same bag in
    both extracts are left out before the shuffle; both extracts are then read twice.
    """
    if part is not None:
        if part not in on:
            raise ValueError(f"{part} is none of {list(on)}")
        new, old = in_changed_parts(new, old, part, on)
    return missing_in_other(new, old, on)


# -- invoice lines and account statements ----------------------------------------


def invoice_lines(ledger: DataFrame, interest: str) -> DataFrame:
    """Income lines of invoices for the customers of interest."""
    rows = ledger.where(
        (F.col("type") == "Invoice") & matches("account", INCOME_ACCOUNTS) & matches("customer", interest)
    )
    named = separate(separate(rows, "account", ["source", "class_"]), "customer", ["client", "project"])
    return named.select("date", "client", "project", F.col("class_").alias("class"), "num", "amount")


def lines_with_open_balance(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """Distinct lines with the open balance of their invoice.

    Copies are removed before the join, so that repeated lines are not shuffled.
    """
    balances = invoices.select("num", "open_balance").distinct()
    return joined(lines.distinct(), balances, ["num"])


def invoice_headers(ledger: DataFrame, invoices: DataFrame, interest: str) -> DataFrame:
    """Invoices found in the ledger for projects of interest, with amount and open balance."""
    keys = ledger.where(F.col("type") == "Invoice").select(
        "date", "num", "customer", "creation_date", "modification_date"
    )
    named = separate(keys, "customer", ["client", "project"]).where(matches("project", interest))
    return joined(named.distinct(), invoices.select("num", "amount", "open_balance"), ["num"])


def invoice_clients(invoices: DataFrame) -> DataFrame:
    """Client and project from a dashed name; the client stands in for a missing project."""
    named = separate(invoices, "name", ["client", "project"], "[-]")
    return named.withColumns(
        {"project": F.trim(F.coalesce("project", "client")), "client": F.trim("client")}
    ).distinct()


def account_statement(
    lines: DataFrame,
    client: str,
    projects: Sequence[tuple[str, str]],
    classes: Mapping[str, str],
) -> dict[str, DataFrame]:
    """Open lines of a client, and the same consolidated per invoice, both by project.

    The classes of an invoice are counted before they are joined to a text, so
    an invoice with very many lines shuffles one row per distinct class.
    """
    detailed = lines.where(matches("client", client) & (F.col("open_balance") > 1)).withColumns(
        {
            "project": alias_matching(F.col("project"), projects, keep_unlisted=False),
            "class": alias_equal(F.col("class"), classes),
        }
    )
    keys = ["date", "client", "project", "num"]
    by_class = detailed.groupBy(*keys, "class").agg(
        F.count(F.lit(1)).alias("n"),
        total_or_null("amount").alias("amount"),
        F.max("open_balance").alias("open_balance"),
    )
    consolidated = by_class.groupBy(*keys).agg(
        total_or_null("amount").alias("amount"),
        F.max("open_balance").alias("open_balance"),
        repeated_text("class", "n").alias("class"),
    )
    by_project = F.asc_nulls_last("project")
    return {"detailed": detailed.orderBy(by_project), "consolidated": consolidated.orderBy(by_project)}


# -- state of account ------------------------------------------------------------


def statement_open(invoices: DataFrame, clues: Sequence[str]) -> DataFrame:
    """Invoices whose client name fits a clue."""
    return with_clues(invoices, "name", clues)


def statement_lines(ledger: DataFrame, clues: Sequence[str]) -> DataFrame:
    """Invoice lines for the clues, their account split into kind of income and service."""
    account = F.col("account")
    rows = ledger.where((F.col("type") == "Invoice") & account.isNotNull() & ~matches(account, RECEIVABLE))
    rows = with_clues(rows, "name", clues)
    placed = [SOURCE_LINE] if SOURCE_LINE in ledger.columns else []
    named = separate(
        separate(
            rows.select("clue", "date", "type", "num", "name", "account", "amount", *placed), "name", ["client", "project"]
        ),
        "account",
        ["income", "service"],
    )
    kinds = (("Operat", "operational"), ("aterial", "material"))
    return named.withColumns(
        {
            # the first character is the account number
            "income": first_hit(F.expr("substring(income, 2)"), kinds),
            "service": F.trim(drop_first_match(F.lower("service"), "income")),
        }
    )


def statement_payments(ledger: DataFrame, clues: Sequence[str]) -> DataFrame:
    rows = ledger.where((F.col("type") == "Payment") & (F.col("amount") > 0))
    return with_clues(rows, "customer", clues).select("clue", "date", "type", "name", "account", "amount")


def state_of_account(ledger: DataFrame, invoices: DataFrame, clues: Sequence[str]) -> dict[str, DataFrame]:
    return {
        "open": statement_open(invoices, clues),
        "lines": statement_lines(ledger, clues),
        "payments": statement_payments(ledger, clues),
    }


def statement_compacted(lines: DataFrame, opened: DataFrame) -> DataFrame:
    """Lines with open balance; a materials line takes the service of the line before.

    The look-back is applied twice over the whole statement and never crosses a clue.  Lines that carry their
    place in the source (``source_line``) follow its order; others a stated one (clue, invoice, day, then all
    other columns).
    """
    full = joined(lines, opened.select("clue", "num", "open_balance"), ["clue", "num"])
    order = ["num", "date", "service", "income", "amount", "client", "project", "type", "open_balance"]
    order = ["clue", *([SOURCE_LINE] if SOURCE_LINE in lines.columns else []), *order]
    placed = OrderedRows(
        full.withColumn("seen", F.struct("clue", "service")), [F.asc_nulls_last(c) for c in order]
    ).with_previous("seen", 2, "before")

    def service_before(k: int) -> Column:
        return F.when(F.col(f"before{k}.clue") == F.col("clue"), F.col(f"before{k}.service"))

    one, two = service_before(1), service_before(2)
    is_materials = F.col("service") == "materials"
    # two passes of "take the line above" written as one choice
    from_above = if_known(one == "materials", two, one)
    return placed.withColumn("service", if_known(is_materials, from_above, F.col("service"))).select(
        *full.columns
    )


def compacted_by_invoice(compacted: DataFrame, without: str | None = None) -> DataFrame:
    """Amount and open balance per project and invoice, with a total per clue."""
    # an invoice has one balance; the latest line decides if an extract holds several
    latest = F.max_by("open_balance", F.struct("date", "service", "income", "amount"))
    grouped = compacted.groupBy("clue", "project", "num").agg(
        total_or_null("amount").alias("amount"), latest.alias("open_balance")
    )
    if without is not None:
        grouped = grouped.where(~matches("project", without))
    return append_total(grouped, "project", by=["clue"])


def charged_by_service(compacted: DataFrame) -> DataFrame:
    grouped = compacted.groupBy("clue", "project", "num", "service").agg(total_or_null("amount").alias("amount"))
    return append_total(grouped, "project", by=["clue"])


def relabelled_lines(compacted: DataFrame, without: str, services: Mapping[str, str]) -> DataFrame:
    """Lines under report names of services, one project excluded, with a total per clue."""
    rows = compacted.where(~matches("project", without)).drop("open_balance")
    return append_total_to_rows(rows.withColumn("service", alias_equal(F.col("service"), services)), "type", by=["clue"])


def invoice_paid(
    opened: DataFrame, services: Sequence[tuple[str, str]], clients: Mapping[str, str]
) -> DataFrame:
    """Client statement: paid amount, service by project name, titled columns."""
    named = separate(opened.select("date", "num", "name", "amount", "open_balance"), "name", ["client", "project"])
    return clean_names(
        named.select(
            "date",
            F.col("num").alias("reference"),
            alias_equal(F.col("client"), clients).alias("client"),
            "project",
            alias_matching(F.col("project"), services).alias("service"),
            "amount",
            "open_balance",
            (F.col("amount") - F.col("open_balance")).alias("amount_paid"),
        ),
        "title",
    ).orderBy(F.asc_nulls_last("Project"), F.asc_nulls_last("Date"))


def invoices_paid_of(invoices: DataFrame, nums: DataFrame) -> DataFrame:
    """Invoices whose number is in ``nums``, paid amount added, with a total row."""
    found = joined(invoices, nums.select("num").distinct(), ["num"], "left_semi")
    return append_total_to_rows(found.withColumn("amount_paid", F.col("amount") - F.col("open_balance")), "date")


# -- invoiced, paid and open per clue ---------------------------------------------


def _state(clues: DataFrame, invoiced: DataFrame, paid: DataFrame) -> DataFrame:
    """One row per clue; a clue without rows has zero sums."""
    invoiced, paid = (side.withColumn(flag, F.lit(True)) for side, flag in ((invoiced, "__i"), (paid, "__p")))
    full = joined(joined(clues, invoiced, ["clue"]), paid, ["clue"])

    def known(column: str, flag: str) -> Column:
        return F.when(F.col(flag).isNull(), F.lit(0)).otherwise(F.col(column)).cast("decimal(28,2)")

    sums = full.select(
        F.col("clue").alias("project"),
        known("invoiced", "__i").alias("invoiced"),
        known("total_paid", "__p").alias("total_paid"),
        known("open_balance", "__i").alias("open_balance"),
    ).withColumn("diff_invoiced_paid", F.col("invoiced") - F.col("total_paid"))
    return sums.withColumn(
        "logical_match", F.bround("diff_invoiced_paid", 0) == F.bround("open_balance", 0)
    )


def _invoiced(rows: DataFrame) -> DataFrame:
    return rows.groupBy("clue").agg(
        total_or_null("amount").alias("invoiced"), total_or_null("open_balance").alias("open_balance")
    )


def _positive_payments(ledger: DataFrame) -> DataFrame:
    return ledger.where((F.col("type") == "Payment") & (F.col("amount") > 0))


def global_state(ledger: DataFrame, invoices: DataFrame, clues: Sequence[str]) -> DataFrame:
    """Invoiced, paid and open per regex clue, and whether they agree to the unit.

    Invoices and payments are summed apart before they meet, so neither side
    multiplies the other.
    """
    wanted = ledger.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(c) for c in clues])).alias("clue"))
    paid = with_clues(_positive_payments(ledger), "customer", clues)
    return _state(
        wanted,
        _invoiced(with_clues(invoices, "name", clues)),
        paid.groupBy("clue").agg(F.sum("amount").alias("total_paid")),
    )


def customer_pareto(ledger: DataFrame, as_of: dt.date, months: int) -> DataFrame:
    """Amount per customer since a month start, share of the total and running share, largest first."""
    since = first_day_of_month(F.add_months(F.lit(as_of), -months))
    by_customer = (
        ledger.where(F.col("date") >= since).groupBy("customer").agg(total_or_zero("amount").alias("amount"))
    )
    order = [F.desc_nulls_last("amount"), F.asc_nulls_last("customer")]
    placed = OrderedRows(by_customer, order, unique=True)
    grand = placed.rows.agg(F.sum("amount").cast("double")).scalar()
    shares = placed.running_total("amount", "running").select(
        "customer",
        "amount",
        F.try_divide(F.col("amount").cast("double"), grand).alias("share"),
        F.try_divide(F.col("running").cast("double"), grand).alias("pareto"),
    )
    return shares.orderBy(*order)


def state_by_clue_table(ledger: DataFrame, invoices: DataFrame, clues: DataFrame, regex: bool = True) -> DataFrame:
    """Invoiced, paid and open for every clue of a table: a regex, or with ``regex`` off a plain text.

    Names and customers are summed before they are matched.  An unknown clue fits nothing.
    """
    wanted = clues.select("clue").distinct()
    wanted = kept(wanted) if regex else wanted
    found = matching_values if regex else containing_values
    by_name = invoices.where(F.col("name").isNotNull()).groupBy("name").agg(
        total_or_null("amount").alias("amount"), total_or_null("open_balance").alias("open_balance")
    )
    by_customer = (
        _positive_payments(ledger)
        .where(F.col("customer").isNotNull())
        .groupBy("customer")
        .agg(F.sum("amount").alias("amount"))
    )
    invoiced = found(by_name, "name", wanted, "clue").join(by_name, "name")
    paid = found(by_customer, "customer", wanted, "clue").join(by_customer, "customer")
    return _state(wanted, _invoiced(invoiced), paid.groupBy("clue").agg(F.sum("amount").alias("total_paid")))


def receivable_perspective(
    ledger: DataFrame, invoices: DataFrame, as_of: dt.date, months: int, regex: bool = False
) -> DataFrame:
    """Invoiced, paid and open for every customer active since a month start.

    Customer names are data: they are looked for as plain text, or as regexes if asked for.
    """
    since = first_day_of_month(F.add_months(F.lit(as_of), -months))
    active = ledger.where(F.col("date") >= since).select(F.col("customer").alias("clue"))
    state = state_by_clue_table(ledger, invoices, active, regex)
    zeros = ["invoiced", "total_paid", "open_balance", "diff_invoiced_paid"]
    # an unknown customer is reported under the text "0"
    return state.fillna(0, zeros).fillna("0", ["project"]).fillna(False, ["logical_match"]).distinct()


def mismatches(perspective: DataFrame, clue: str) -> DataFrame:
    """Projects of a clue whose invoiced minus paid differs from what is open."""
    return perspective.where(matches("project", clue) & ~F.col("logical_match")).select("project")


# -- smaller extracts --------------------------------------------------------------


def amount_by_type(ledger: DataFrame, names: DataFrame) -> DataFrame:
    """Positive amounts by name and type for a set of names, receivables aside."""
    sums = (
        ledger.where((F.col("amount") > 0) & ~matches("account", "Accounts R"))
        .groupBy("name", "type")
        .agg(F.sum("amount").alias("amount"))
    )
    return joined(sums, names.select("name").distinct(), ["name"], "left_semi")


def invoice_subset_total(ledger: DataFrame, nums: DataFrame) -> DataFrame:
    """Lines of the listed invoices without receivables, with a total row."""
    rows = ledger.where(F.col("account").isNotNull() & ~matches("account", "Recei")).fillna(0, ["amount"])
    found = joined(rows, nums.select("num").distinct(), ["num"], "left_semi")
    return append_total_to_rows(found.drop("memo", "name", "creation_date"), "type")


def client_balance(ledger: DataFrame, invoices: DataFrame, client: str) -> DataFrame:
    """Invoices and credit memos of a client on receivable accounts, with what is open, by project.

    A document the invoice list does not know is open in full.
    """
    rows = ledger.where(
        F.col("type").isin("Invoice", "Credit Memo") & matches("name", client) & matches("account", "Account")
    ).select("date", "type", "num", "customer", "account", "amount", "creation_date")
    full = joined(rows, invoices.select("num", "open_balance"), ["num"])
    named = separate(full, "customer", ["client", "project"]).drop("client")
    return named.withColumn("open_balance", F.coalesce("open_balance", "amount")).orderBy(F.asc_nulls_last("project"))


def bank_receipts(statement: DataFrame, description: str, origin: str = "1899-12-30") -> DataFrame:
    """Incoming bank lines whose description fits."""
    rows = statement.where((F.col("valor") > 0) & matches("descripcion", description))
    return rows.withColumn("fecha", serial_day("fecha", origin)).drop("documento")


def trimmed_reference(invoices_b: DataFrame) -> DataFrame:
    """The second system's invoices under the first system's column names."""
    return invoices_b.select(
        F.col("invoice_date").alias("date"), tidy_text("reference").alias("num"), "project", "amount"
    )
