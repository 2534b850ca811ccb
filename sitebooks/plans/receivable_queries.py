"""Named queries: receivables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import receivables as R
from ..session import kept
from ..sources import bag_delta
from .registry import AS_OF, STEPS, Tables, query

CLUES = ["BUILD", "MACH", "no such client"]
INTEREST = "BUILD|MACH|HOUSE"
PROJECTS = (("BUILD", "Main Building"), ("MACH", "Machine Hall"))
CLASSES = {"Materials Income": "Materials", "Billable Extras": "Extras"}

STEPS["aging"] = f"""
select type, num, date, due_date, name, amount, open_balance, x_priority,
  open_balance::double / nullif(amount, 0)::double as pending_share,
  1 - open_balance::double / nullif(amount, 0)::double as paid_share,
  case when amount is null then null when amount > 6000 then amount * 0.25 else open_balance end as expected_payment,
  date '{AS_OF}' - date as debt_days, case project_name when 'FURNITURE' then 'Workshop' else project_name end as project
from invoices where open_balance <> 0"""
STEPS["income_lines"] = f"""
select distinct date, split_part(customer, ':', 1) as client, nullif(split_part(customer, ':', 2), '') as project,
  nullif(split_part(account, ':', 2), '') as class, num, amount from ledger
where type = 'Invoice' and regexp_matches(account, '.Operational|Material') and regexp_matches(customer, '{INTEREST}')"""
STEPS["open_lines"] = """
select distinct l.*, i.open_balance from income_lines l left join invoices i on l.num is not distinct from i.num"""
STEPS["statement_detail"] = """
select date, client, case when project like '%BUILD%' then 'Main Building' when project like '%MACH%' then 'Machine Hall' end
  as project, case class when 'Materials Income' then 'Materials' when 'Billable Extras' then 'Extras' else class end as class,
  num, amount, open_balance from open_lines where client like '%Customer%' and open_balance > 1"""
STEPS["clue"] = "select unnest(['BUILD', 'MACH', 'no such client']) as clue"
STEPS["open_by_clue"] = "select c.clue, i.* from invoices i join clue c on regexp_matches(i.name, c.clue)"
STEPS["lines_by_clue"] = """
select clue, date, type, num, split_part(name, ':', 1) as client, nullif(split_part(name, ':', 2), '') as project,
  case when regexp_matches(substr(split_part(account, ':', 1), 2), 'Operat') then 'operational'
    when regexp_matches(substr(split_part(account, ':', 1), 2), 'aterial') then 'material' end as income,
  case when account like '%:%' then trim(regexp_replace(lower(split_part(account, ':', 2)), 'income', '')) end as service,
  amount from ledger join clue on regexp_matches(name, clue)
where type = 'Invoice' and account is not null and not regexp_matches(account, 'Receiv')"""
STEPS["payments_by_clue"] = """
select clue, date, type, name, account, amount from ledger join clue on regexp_matches(customer, clue)
where type = 'Payment' and amount > 0"""
STEPS["pass_zero"] = """
select l.*, o.open_balance, row_number() over (order by l.clue nulls last, l.num nulls last, l.date nulls last,
  l.service nulls last, l.income nulls last, l.amount nulls last, l.client nulls last, l.project nulls last, l.type nulls last)
  as pos from lines_by_clue l left join open_by_clue o on l.clue = o.clue and l.num is not distinct from o.num"""
STEPS["pass_one"] = """
select * replace (case when service is null then null when service = 'materials' then
  lag(service) over (partition by clue order by pos) else service end as service) from pass_zero"""
STEPS["compacted"] = """
select * exclude (pos) replace (case when service is null then null when service = 'materials' then
  lag(service) over (partition by clue order by pos) else service end as service) from pass_one"""
_ALL = "case when count(*) = count(amount) then sum(amount) end"


@query(
    "invoice_aging",
    """select * replace (round(pending_share, 6) as pending_share, round(paid_share, 6) as paid_share,
      amount::double as amount, open_balance::double as open_balance, expected_payment::double as expected_payment)
    from aging""",
)
def invoice_aging(t: Tables):
    return R.invoice_aging(t.view("invoices"), AS_OF, {"FURNITURE": "Workshop"})


@query("expected_by_project", "select project, sum(expected_payment)::double as expected_payment from aging group by 1")
def expected_by_project(t: Tables):
    return R.expected_by_project(R.invoice_aging(t.view("invoices"), AS_OF, {"FURNITURE": "Workshop"}))


@query(
    "missing_invoices",
    """select num, date, name, amount::double as amount, open_balance::double as open_balance from invoices a
    where not exists (select 1 from invoices_b b where b.invoice_date = a.date and trim(b.reference) = a.num)""",
)
def missing_invoices(t: Tables):
    a = t.view("invoices").select("num", "date", "name", "amount", "open_balance")
    return R.missing_in_other(a, R.trimmed_reference(t.view("invoices_b")), ["date", "num"])


@query(
    "missing_invoices_b",
    """select invoice_date as date, trim(reference) as num, project, amount::double as amount from invoices_b b
    where not exists (select 1 from invoices a where b.invoice_date = a.date and trim(b.reference) = a.num)""",
)
def missing_invoices_b(t: Tables):
    return R.missing_in_other(R.trimmed_reference(t.view("invoices_b")), t.view("invoices"), ["date", "num"])


@query(
    "missing_open_invoices",
    """select date, num as ref, amount::double as amount from invoices a where open_balance > 0
    and not exists (select 1 from invoices_b b where trim(b.reference) = a.num)""",
)
def missing_open_invoices(t: Tables):
    a = t.view("invoices").where("open_balance > 0").select("date", F.col("num").alias("ref"), "amount")
    return R.missing_in_other(a, R.trimmed_reference(t.view("invoices_b")), [("ref", "num")])


@query(
    "snapshot_delta",
    """select date, type, num, name, account, amount::double as amount from ledger l where not exists (
      select 1 from ledger o where o.date < '2001-10-01' and o.date is not distinct from l.date
      and o.name is not distinct from l.name and o.amount is not distinct from l.amount)""",
)
def snapshot_delta(t: Tables):
    new = kept(t.ledger("date", "type", "num", "name", "account", "amount"))
    return R.snapshot_delta(new, new.where("date < '2001-10-01'"), part="date")


@query(
    "snapshot_bag_delta",
    """with n as (select date, type, name, account, amount from ledger),
      o as (select date + case when month(date) = 2 then 1 else 0 end as date, type, name, account, amount
        from ledger where date < '2001-10-01'),
      d as (select *, 1 as copy from (select * from n except all select * from o) a
        union all select *, -1 from (select * from o except all select * from n) b)
    select date, type, name, account, amount::double as amount, sum(copy)::bigint as copies from d group by all""",
)
def snapshot_bag_delta(t: Tables):
    """The old extract has the earlier months, its February rows a day later."""
    new = kept(t.ledger("date", "type", "name", "account", "amount"))
    moved = F.date_add("date", F.when(F.month("date") == 2, 1).otherwise(0))
    old = new.where("date < '2001-10-01'").withColumn("date", moved)
    return bag_delta(new, old, part="date")


@query("invoice_lines_open", "select * replace (amount::double as amount, open_balance::double as open_balance) from open_lines")
def invoice_lines_open(t: Tables):
    lines = R.invoice_lines(t.ledger("date", "type", "account", "customer", "num", "amount"), INTEREST)
    return R.lines_with_open_balance(lines, t.view("invoices"))


@query(
    "invoice_headers",
    f"""select h.*, i.amount::double as amount, i.open_balance::double as open_balance from (
      select distinct date, num, split_part(customer, ':', 1) as client, split_part(customer, ':', 2) as project,
        creation_date, modification_date from ledger
      where type = 'Invoice' and regexp_matches(split_part(customer, ':', 2), '{INTEREST}')) h
    left join invoices i on h.num = i.num""",
)
def invoice_headers(t: Tables):
    rows = t.ledger("date", "type", "num", "customer", "creation_date", "modification_date")
    return R.invoice_headers(rows, t.view("invoices"), INTEREST)


@query(
    "invoice_clients",
    """select distinct num, date, amount::double as amount, open_balance::double as open_balance,
      trim(split_part(name, '-', 1)) as client,
      trim(case when name like '%-%' then split_part(name, '-', 2) else name end) as project from (
        select num, date, amount, open_balance, replace(name, ':', ' - ') as name from invoices) i""",
)
def invoice_clients(t: Tables):
    dashed = F.replace(F.col("name"), F.lit(":"), F.lit(" - ")).alias("name")
    return R.invoice_clients(t.view("invoices").select("num", "date", dashed, "amount", "open_balance"))


def _statement(t: Tables):
    lines = R.invoice_lines(t.ledger("date", "type", "account", "customer", "num", "amount"), INTEREST)
    full = R.lines_with_open_balance(lines, t.view("invoices"))
    return R.account_statement(full, "Customer", PROJECTS, CLASSES)


@query(
    "account_statement_detailed",
    "select * replace (amount::double as amount, open_balance::double as open_balance) from statement_detail",
)
def account_statement_detailed(t: Tables):
    return _statement(t)["detailed"]


@query(
    "account_statement",
    f"""select date, client, project, num, ({_ALL})::double as amount, max(open_balance)::double as open_balance,
      case when count(*) = count(class) then string_agg(class, ',' order by class) end as class
    from statement_detail group by date, client, project, num""",
)
def account_statement(t: Tables):
    return _statement(t)["consolidated"]


@query(
    "statement_open",
    "select clue, date, num, name, amount::double as amount, open_balance::double as open_balance from open_by_clue",
)
def statement_open(t: Tables):
    rows = t.view("invoices").select("date", "num", "name", "amount", "open_balance")
    return R.statement_open(rows, CLUES)


_LINE_COLUMNS = ("date", "type", "num", "name", "account", "amount")


@query("statement_lines", "select * replace (amount::double as amount) from lines_by_clue")
def statement_lines(t: Tables):
    return R.statement_lines(t.ledger(*_LINE_COLUMNS), CLUES)


@query("statement_payments", "select * replace (amount::double as amount) from payments_by_clue")
def statement_payments(t: Tables):
    return R.statement_payments(t.ledger(*_LINE_COLUMNS, "customer"), CLUES)


def _compacted(t: Tables):
    return R.statement_compacted(
        R.statement_lines(t.ledger(*_LINE_COLUMNS), CLUES), R.statement_open(t.view("invoices"), CLUES)
    )


@query("statement_compacted", "select * replace (amount::double as amount, open_balance::double as open_balance) from compacted")
def statement_compacted(t: Tables):
    return _compacted(t)


@query(
    "statement_by_invoice",
    f"""with g as (select clue, project, num, {_ALL} as amount, max(open_balance) as open_balance from compacted
      group by clue, project, num having not coalesce(regexp_matches(project, 'FURN'), false))
    select clue, project, num, amount::double as amount, open_balance::double as open_balance from g
    union all select clue, 'Total', '-', coalesce(sum(amount), 0)::double, coalesce(sum(open_balance), 0)::double
    from g group by clue""",
)
def statement_by_invoice(t: Tables):
    return R.compacted_by_invoice(_compacted(t), without="FURN")


@query(
    "charged_by_service",
    f"""with g as (select clue, project, num, service, {_ALL} as amount from compacted group by 1, 2, 3, 4)
    select clue, project, num, service, amount::double as amount from g
    union all select clue, 'Total', '-', '-', coalesce(sum(amount), 0)::double from g group by clue""",
)
def charged_by_service(t: Tables):
    return R.charged_by_service(_compacted(t))


@query(
    "relabelled_lines",
    """with g as (select clue, date, type, num, client, project, income, amount,
        case service when 'brand#1' then 'installations' when 'brand#2' then 'drywall & finish' else service end as service
      from compacted where not coalesce(regexp_matches(project, 'MACH'), false))
    select * replace (amount::double as amount) from g union all
    select clue, null, 'Total', '-', '-', '-', '-', coalesce(sum(amount), 0)::double, '-' from g group by clue""",
)
def relabelled_lines(t: Tables):
    return R.relabelled_lines(
        _compacted(t), without="MACH", services={"brand#1": "installations", "brand#2": "drywall & finish"}
    )


@query(
    "invoice_paid",
    """select date as "Date", num as "Reference",
      case split_part(name, ':', 1) when 'Customer#000000001' then 'First Customer' else split_part(name, ':', 1) end as "Client",
      split_part(name, ':', 2) as "Project", case when name like '%:%BUILD%' then 'Stucco' when name like '%:%MACH%'
      then 'Painting' else split_part(name, ':', 2) end as "Service", amount::double as "Amount",
      open_balance::double as "Open Balance", (amount - open_balance)::double as "Amount Paid" from open_by_clue""",
)
def invoice_paid(t: Tables):
    opened = R.statement_open(t.view("invoices"), CLUES)
    return R.invoice_paid(opened, (("BUILD", "Stucco"), ("MACH", "Painting")), {"Customer#000000001": "First Customer"})


@query(
    "project_invoices_paid",
    """with g as (select cast(date as varchar) as date, num, name, amount, open_balance, amount - open_balance as amount_paid
      from invoices where num in (select num from income_lines))
    select date, num, name, amount::double as amount, open_balance::double as open_balance,
      amount_paid::double as amount_paid from g
    union all select 'Total', '-', '-', coalesce(sum(amount), 0)::double, coalesce(sum(open_balance), 0)::double,
      coalesce(sum(amount_paid), 0)::double from g""",
)
def project_invoices_paid(t: Tables):
    lines = R.invoice_lines(t.ledger("date", "type", "account", "customer", "num", "amount"), INTEREST)
    listed = t.view("invoices").select(F.col("date").cast("string"), "num", "name", "amount", "open_balance")
    return R.invoices_paid_of(listed, lines)


_STATE = """
  invoiced::double as invoiced, total_paid::double as total_paid, (invoiced - total_paid)::double as diff_invoiced_paid,
  open_balance::double as open_balance,
  round_even((invoiced - total_paid)::double, 0) = round_even(open_balance::double, 0) as logical_match"""
STEPS["active"] = "select distinct customer from ledger where date >= '2001-06-01'"
STEPS["perspective"] = f"""
select project, {_STATE} from (
  select coalesce(a.customer, '0') as project,
    (select coalesce(sum(amount), 0) from invoices i where contains(i.name, a.customer)) as invoiced,
    (select coalesce(sum(open_balance), 0) from invoices i where contains(i.name, a.customer)) as open_balance,
    (select coalesce(sum(amount), 0) from ledger p where p.type = 'Payment' and p.amount > 0
      and contains(p.customer, a.customer)) as total_paid from active a) s"""


@query(
    "global_state",
    f"""select project, {_STATE} from (select clue as project,
      (select coalesce(sum(amount), 0) from open_by_clue o where o.clue = c.clue) as invoiced,
      (select coalesce(sum(open_balance), 0) from open_by_clue o where o.clue = c.clue) as open_balance,
      (select coalesce(sum(amount), 0) from payments_by_clue p where p.clue = c.clue) as total_paid from clue c) s""",
)
def global_state(t: Tables):
    return R.global_state(t.ledger("type", "customer", "amount"), t.view("invoices"), CLUES)


@query(
    "customer_pareto",
    """with g as (select customer, sum(coalesce(amount, 0)) as amount from ledger where date >= '2001-06-01' group by 1)
    select customer, amount::double as amount, round(amount::double / (select sum(amount) from g)::double, 6) as share,
      round((sum(amount) over (order by amount desc, customer nulls last rows unbounded preceding))::double
        / (select sum(amount) from g)::double, 6) as pareto from g""",
)
def customer_pareto(t: Tables):
    return R.customer_pareto(t.ledger("date", "customer", "amount"), AS_OF, 5)


@query(
    "clue_table_state",
    f"""select project, {_STATE} from (select clue as project,
      (select coalesce(sum(amount), 0) from invoices i where regexp_matches(i.name, clue)) as invoiced,
      (select coalesce(sum(open_balance), 0) from invoices i where regexp_matches(i.name, clue)) as open_balance,
      (select coalesce(sum(amount), 0) from ledger p where p.type = 'Payment' and p.amount > 0
        and regexp_matches(p.customer, clue)) as total_paid from clue_table) s""",
)
def clue_table_state(t: Tables):
    rows = t.ledger("type", "customer", "amount")
    return R.state_by_clue_table(rows, t.view("invoices"), t.view("clue_table"))


@query("receivable_perspective", "select * from perspective")
def receivable_perspective(t: Tables):
    rows = t.ledger("date", "type", "customer", "amount")
    return R.receivable_perspective(rows, t.view("invoices"), AS_OF, 5).orderBy(F.desc("open_balance"))


@query(
    "receivable_mismatch",
    "select project from perspective where regexp_matches(project, 'BUILD') and not logical_match",
)
def receivable_mismatch(t: Tables):
    rows = t.ledger("date", "type", "customer", "amount")
    return R.mismatches(R.receivable_perspective(rows, t.view("invoices"), AS_OF, 5), "BUILD")


@query(
    "type_amount_by_name",
    """select name, type, sum(amount)::double as amount from ledger where amount > 0
      and not coalesce(regexp_matches(account, 'Accounts R'), false)
      and name in (select name from invoices where open_balance > 0) group by name, type""",
)
def type_amount_by_name(t: Tables):
    names = t.view("invoices").where("open_balance > 0")
    return R.amount_by_type(t.ledger("name", "type", "account", "amount"), names)


@query(
    "invoice_subset_total",
    """with g as (select cast(date as varchar) as date, type, num, account, coalesce(amount, 0) as amount, customer, class
      from ledger where account is not null and not regexp_matches(account, 'Recei')
      and num in (select num from invoices where due_date >= '2001-08-01'))
    select * replace (amount::double as amount) from g
    union all select '-', 'Total', '-', '-', coalesce(sum(amount), 0)::double, '-', '-' from g""",
)
def invoice_subset_total(t: Tables):
    rows = t.ledger("date", "type", "num", "account", "amount", "customer", "class")
    overdue = t.view("invoices").where("due_date >= '2001-08-01'")
    return R.invoice_subset_total(rows.withColumn("date", F.col("date").cast("string")), overdue)


@query(
    "client_balance",
    """select l.date, l.type, l.num, l.account, l.amount::double as amount, l.creation_date,
      nullif(split_part(l.customer, ':', 2), '') as project, coalesce(i.open_balance, l.amount)::double as open_balance
    from ledger l left join invoices i on l.num = i.num where l.type in ('Invoice', 'Credit Memo')
      and regexp_matches(l.name, 'AUTO') and regexp_matches(l.account, 'Account')""",
)
def client_balance(t: Tables):
    rows = t.ledger("date", "type", "num", "name", "customer", "account", "amount", "creation_date")
    return R.client_balance(rows, t.view("invoices"), "AUTO")


@query(
    "bank_receipts",
    """select date '1899-12-30' + fecha::int as fecha, descripcion, valor::double as valor from bank_statement
    where valor > 0 and descripcion like '%INTERNA%'""",
)
def bank_receipts(t: Tables):
    return R.bank_receipts(t.view("bank_statement"), "INTERNA")
