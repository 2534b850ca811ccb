"""Named queries: reconciliation, subcontracts, project control, payroll."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import controls as C
from ..operators import projects as J
from ..operators import reconcile as Q
from .registry import AS_OF, STEPS, Tables, query

INTEREST = "BUILD|MACH|HOUSE"
ALIASES = (("BUILD", "Main Building"), ("MACH", "Machine Hall"))
DAY = "2001-06-15"
VENDOR = "^Supplier#"
PAY_WINDOW = ("1996-01-24", "2001-01-24")
_ALL = "case when count(*) = count(amount_paid) then sum(amount_paid) end"
_COST = "regexp_matches(account, 'Indirect|Labor|Direct Material|Fees|Services|Officer')"

STEPS["books"] = f"select date, amount from ledger where {_COST} and regexp_matches(customer, 'BUILD')"
STEPS["books_b"] = """
select payment_date as date, coalesce(amount_paid, 0) as amount from payments_b where regexp_matches(project, 'BUILD')"""
_SAME = "b.date is not distinct from a.date and b.amount is not distinct from a.amount"


def _only(a: str, b: str) -> str:
    return f"select date, amount::double as amount from {a} a where not exists (select 1 from {b} b where {_SAME})"


def _books(t: Tables):
    rows = J.project_expenses(t.ledger("date", "customer", "account", "amount"), ["BUILD"])
    return rows.select("date", "amount"), Q.system_b_payments(t.view("payments_b"), "BUILD")


@query("reconcile_ledger_only", _only("books", "books_b"))
def reconcile_ledger_only(t: Tables):
    return Q.only_in_first(*_books(t))


@query("reconcile_system_b_only", _only("books_b", "books"))
def reconcile_system_b_only(t: Tables):
    return Q.only_in_first(*reversed(_books(t)))


@query(
    "reconcile_totals",
    f"""select *, total_b - only_b + only_ledger as reconciled from (select
      (select coalesce(sum(amount), 0)::double from books) as total_ledger,
      (select coalesce(sum(amount), 0)::double from books_b) as total_b,
      (select coalesce(sum(amount), 0)::double from books a where not exists (select 1 from books_b b where {_SAME})) as only_ledger,
      (select coalesce(sum(amount), 0)::double from books_b a where not exists (select 1 from books b where {_SAME})) as only_b) s"""
    .replace("total_b - only_b + only_ledger as", "round(total_b - only_b + only_ledger, 2) as"),
)
def reconcile_totals(t: Tables):
    return Q.reconcile_totals(*_books(t))


STEPS["bills"] = "select date, amount from ledger where type = 'Bill'"
STEPS["bills_b"] = "select payment_date as date, amount_paid as amount from payments_b"


def _bills(t: Tables):
    bills = t.ledger("date", "type", "amount").where("type = 'Bill'").select("date", "amount")
    return bills, Q.system_b_payments(t.view("payments_b"), zero_missing=False)


@query("reconcile_bills_ledger_only", _only("bills", "bills_b"))
def reconcile_bills_ledger_only(t: Tables):
    return Q.only_in_first(*_bills(t))


@query("reconcile_bills_system_b_only", _only("bills_b", "bills"))
def reconcile_bills_system_b_only(t: Tables):
    return Q.only_in_first(*reversed(_bills(t)))


@query(
    "reconcile_day_ledger",
    f"""with g as (select date, type, num, name, class, amount from ledger
      where regexp_matches(customer, 'BUILD|MACH') and date = '{DAY}')
    select * replace (amount::double as amount) from g
    union all select null, 'Total', '-', '-', '-', coalesce(sum(amount), 0)::double from g""",
)
def reconcile_day_ledger(t: Tables):
    rows = t.ledger("date", "type", "num", "name", "class", "customer", "split", "account", "amount")
    return Q.day_in_ledger(rows, "BUILD|MACH", DAY)


@query(
    "reconcile_day_system_b",
    f"""with g as (select payment_date as date, transaction_type as type, project, services, subcontract, subcontract_name,
        amount_paid as amount, trim(resource) as name from payments_b
      where regexp_matches(project, 'BUILD|MACH') and payment_date = '{DAY}')
    select * replace (amount::double as amount) from g
    union all select null, 'Total', '-', '-', '-', '-', coalesce(sum(amount), 0)::double, '-' from g""",
)
def reconcile_day_system_b(t: Tables):
    return Q.day_in_system_b(t.view("payments_b"), "BUILD|MACH", DAY)


_RENAMED = {"MACHINERY": "Machine Hall", "FURNITURE": "Workshop"}
STEPS["tracked"] = """
select date '1899-12-30' + transaction_date::int as transaction_date, trim(service) as service, amount_paid,
  case trim(project) when 'MACHINERY' then 'Machine Hall' when 'FURNITURE' then 'Workshop' else trim(project) end as project
from payments_track"""
STEPS["attached"] = """
select t.*, s.subcontract_id from tracked t left join subcontract_list s
  on t.project is not distinct from s.project and t.service is not distinct from s.service"""


@query("attach_subcontract", "select * replace (amount_paid::double as amount_paid) from attached")
def attach_subcontract(t: Tables):
    return Q.attach_subcontract(t.view("payments_track"), t.view("subcontract_list"), _RENAMED)


@query("missing_subcontract", "select distinct project, service from attached where subcontract_id is null")
def missing_subcontract(t: Tables):
    return Q.missing_subcontract(t.view("payments_track"), t.view("subcontract_list"), _RENAMED)


@query(
    "paid_by_subcontract",
    f"""select p.*, c.contract::double as contract from (select project, subcontract, services as service, resource,
      ({_ALL})::double as "check" from payments_b where regexp_matches(project, 'BUILD') group by 1, 2, 3, 4) p
    left join (select subcontract_id, max(contract_amount) as contract from contracts group by 1) c
      on p.subcontract = c.subcontract_id""",
)
def paid_by_subcontract(t: Tables):
    short = t.view("payments_b").select(
        "project", "subcontract", F.col("services").alias("service"), "resource", F.col("amount_paid").alias("check")
    )
    listed = t.view("contracts").select(
        F.col("subcontract_id").alias("subcontract"), F.col("contract_amount").alias("contract")
    )
    return Q.paid_by_subcontract(short, listed, "BUILD")


@query(
    "payment_checker",
    """with g as (select subcontract_name, subcontract, transaction_type, sum(coalesce(amount_paid, 0)) as amount
      from payments_b where regexp_matches(project, 'AUTO') group by 1, 2, 3)
    select * replace (amount::double as amount) from g union all select 'Total', '-', '-', sum(amount)::double from g""",
)
def payment_checker(t: Tables):
    return Q.payment_checker(t.view("payments_b"), "AUTO")


@query(
    "payments_on_date",
    f"""with g as (select project, subcontract, subcontract_name, {_ALL} as amount, date '{DAY}' as payment_date
      from payments_b where payment_date = '{DAY}' group by 1, 2, 3)
    select * replace (amount::double as amount) from g
    union all select 'Total', '-', '-', coalesce(sum(amount), 0)::double, null from g""",
)
def payments_on_date(t: Tables):
    return Q.payments_on_date(t.view("payments_b"), DAY)


_OPEN = "in (select project from open_projects)"


@query(
    "project_filter_counts",
    f"""select project, trim(subcontract_name) as subcontract_name, count(*) as n from subcontracts
    where project {_OPEN} group by 1, 2""",
)
def project_filter_counts(t: Tables):
    return C.project_filter_counts(t.view("subcontracts"), t.view("open_projects"))


_ALIAS = """case when project like '%BUILD%' then 'Main Building' when project like '%MACH%' then 'Machine Hall'
  else project end"""
STEPS["paid_kinds"] = f"""
select {_ALIAS} as project, services as service,
  case when count(*) filter (transaction_type <> 'Expense') > 0 then
    coalesce(sum(amount_paid) filter (transaction_type <> 'Expense'), 0) end as labor,
  case when count(*) filter (transaction_type = 'Expense') > 0 then
    coalesce(sum(amount_paid) filter (transaction_type = 'Expense'), 0) end as materials
from payments_b where regexp_matches(project, '{INTEREST}') group by 1, 2"""


@query("payments_by_kind", "select * replace (labor::double as labor, materials::double as materials) from paid_kinds")
def payments_by_kind(t: Tables):
    return C.payments_by_kind(t.view("payments_b"), INTEREST, ALIASES, skip_missing=True)


@query(
    "subcontract_vs_payments",
    f"""select s.*, labor::double as labor, materials::double as materials from (
      select distinct {_ALIAS} as project, service, trim(subcontract_name) as subcontract_name,
        contract_amount::double as subcontract_amount, budget_days from subcontracts
      where regexp_matches(project, '{INTEREST}') and subcontract_name not like '%Old%') s
    left join paid_kinds p on s.project is not distinct from p.project and s.service is not distinct from p.service""",
)
def subcontract_vs_payments(t: Tables):
    return C.open_project_book(t.view("subcontracts"), t.view("payments_b"), INTEREST, ALIASES, skip_missing=True)["consolid"]


@query(
    "payment_details",
    f"""select payment_date as date, {_ALIAS} as project, services as service, trim(subcontract_name) as subcontract_name,
      subcontract as subcontract_id, case when transaction_type = 'Expense' then 'Materials' else 'Labor' end as type,
      amount_paid::double as amount from payments_b where regexp_matches(project, '{INTEREST}')""",
)
def payment_details(t: Tables):
    return C.open_project_book(t.view("subcontracts"), t.view("payments_b"), INTEREST, ALIASES)["detail_payments"]


@query(
    "subcontract_table",
    f"""select {_ALIAS} as project, service, trim(subcontract_name) as subcontract_name,
      contract_amount::double as subcontract_amount, budget_days from subcontracts
    where regexp_matches(project, '{INTEREST}') and subcontract_name not like '%Old%'""",
)
def subcontract_table(t: Tables):
    return C.open_project_book(t.view("subcontracts"), t.view("payments_b"), INTEREST, ALIASES)["subct_raw"]


def _typed(keys: str) -> str:
    def of(kind: str) -> str:
        return (
            f"coalesce(case when count(*) filter (transaction_type = '{kind}') = count(amount_paid) filter "
            f"(transaction_type = '{kind}') then sum(amount_paid) filter (transaction_type = '{kind}') end, 0)"
        )

    return f"""select {keys}, {of('Subcontract')} + {of('Hourly Labor')} as labor_paid, {of('Expense')} as materials_paid
      from payments_b where project {_OPEN} group by {keys}"""


STEPS["analysis_base"] = f"""
select p.*, c.contract_amount as labor_budget, c.contract_amount * case when subcontract_name like '%Dryw%' then 0.40
    when subcontract_name like '%Fram%' then 0.60 when subcontract_name like '%Stuc%' then 0.12
    when subcontract_name like '%Inst%' then 0.20 when subcontract_name like '%Fini%' then 0.15
    when subcontract_name like '%Pain%' then 0.20 end as materials_budget
from ({_typed('project, services, subcontract, subcontract_name')}) p
left join contracts c on c.subcontract_id = p.subcontract and c.project = p.project"""
STEPS["analysis"] = """
select upper(project[1]) || lower(project[2:12]) as short_name, project, regexp_extract(subcontract, '[0-9]+') as subct_id,
  trim(subcontract_name) as subcontract_name, 1.0::double as completion, labor_budget::double as labor_budget,
  labor_budget::double as accrued_labor, labor_paid::double as labor_paid,
  round(1 - labor_paid::double / nullif(labor_budget, 0)::double, 6) as labor_ratio,
  materials_budget::double as materials_budget, materials_budget::double as accrued_materials,
  materials_paid::double as materials_paid,
  round(1 - materials_paid::double / nullif(materials_budget, 0)::double, 6) as materials_ratio from analysis_base"""


@query("project_analysis", "select * from analysis")
def project_analysis(t: Tables):
    return C.project_analysis(t.view("payments_b"), t.view("contracts"), t.view("open_projects"))


@query(
    "project_analysis_summary",
    """select a.project, a.subcontract_name as service, round(labor_paid + materials_paid, 2) as cost_realised,
      labor_paid as labor_cost, materials_paid as material_cost, s.sale_price::double as sale_price,
      round(s.sale_price::double - round(labor_paid + materials_paid, 2), 2) as result,
      round(1 - round(labor_paid + materials_paid, 2) / nullif(s.sale_price, 0)::double, 6) as return_share
    from analysis a left join (select project, trim(controlabor_name) as service, max(bid_price) as sale_price
      from labor_controls group by 1, 2) s on a.project = s.project and a.subcontract_name = s.service""",
)
def project_analysis_summary(t: Tables):
    analysis = C.project_analysis(t.view("payments_b"), t.view("contracts"), t.view("open_projects"))
    prices = t.view("labor_controls").groupBy("project", F.trim("controlabor_name").alias("service")).agg(
        F.max("bid_price").alias("sale_price")
    )
    return C.project_analysis_summary(analysis, prices)


@query(
    "change_orders",
    """select project, 'CO000' || coalesce(cast(change_order_number as varchar), 'NA') as co_num, agreement_date
    from change_orders where project in (select project from analysis)""",
)
def change_orders(t: Tables):
    analysis = C.project_analysis(t.view("payments_b"), t.view("contracts"), t.view("open_projects"))
    return C.change_orders(t.view("change_orders"), analysis)


STEPS["logged"] = f"""
select project_name as project, trim(split_part(controlabor, '-', 1)) as servicio, sum(duration)::bigint as hours_registered,
  min(task_date) as start_date, sum(duration)::bigint * 21 as estimated_cost from time_logs
where controlabor not like '%Maintenance%' and project_name {_OPEN} group by 1, 2"""
STEPS["control"] = f"""
select p.project, trim(p.subcontract_name) as servicio, l.start_date, bid_price::double as bid_price,
  date '{AS_OF}' as revision, 1.0::double as completion, labor_amount::double as labor_budget,
  labor_amount::double as labor_budget_completed, labor_paid::double as labor_paid,
  (labor_paid - labor_amount)::double as labor_over_budget, materials::double as materials_budget,
  materials::double as materials_budget_completed, materials_paid::double as materials_paid,
  (materials_paid - materials)::double as materials_over_budget, budget_days, used_days,
  coalesce(hours_registered, 0) as hours_registered, budget_days - used_days as remaining_days,
  (bid_price - materials - labor_amount)::double as expected_profit,
  (bid_price - labor_paid - materials_paid)::double as current_profit,
  (bid_price - materials_paid - labor_paid)::double as real_profit
from ({_typed('project, subcontract, subcontract_name')}) p
left join labor_controls c on c.project = p.project and c.controlabor_id = p.subcontract and c.controlabor_name = p.subcontract_name
left join logged l on l.project = p.project and l.servicio = trim(p.subcontract_name)"""


@query("time_log_totals", "select * from logged")
def time_log_totals(t: Tables):
    return C.time_log_totals(t.view("time_logs"), t.view("open_projects"))


def _control(t: Tables):
    return C.project_control(
        t.view("payments_b"), t.view("labor_controls"), t.view("time_logs"), t.view("open_projects"), AS_OF
    )


@query("project_control", "select * from control")
def project_control(t: Tables):
    return _control(t)


@query(
    "project_control_short",
    """select project, servicio, start_date, bid_price, completion, labor_budget, labor_paid, materials_budget,
      materials_paid from control""",
)
def project_control_short(t: Tables):
    return C.project_control_short(_control(t))


@query(
    "paid_last_week",
    f"""select project, trim(subcontract_name) as subcontract_name, transaction_type, ({_ALL})::double as amount_paid
    from payments_b where payment_date > '2001-10-28' and project {_OPEN} group by 1, 2, 3""",
)
def paid_last_week(t: Tables):
    return C.paid_last_week(t.view("payments_b"), t.view("open_projects"), AS_OF)


@query(
    "labor_paid_update",
    f"""select project, subcontract_name, coalesce(sum(amount_paid), 0)::double as amount_paid from payments_b
    where regexp_matches(project, 'BUILD') and transaction_type <> 'Expense' and regexp_matches(subcontract_name, 'Dry|Stu')
      and project {_OPEN} group by 1, 2""",
)
def labor_paid_update(t: Tables):
    return C.labor_paid_update(t.view("payments_b"), t.view("open_projects"), "BUILD", "Dry|Stu", skip_missing=True)


@query("time_log_start", "select * from time_logs where regexp_matches(project_name, 'HOUSE')")
def time_log_start(t: Tables):
    return C.time_log_start(t.view("time_logs"), "HOUSE")


@query(
    "project_rollup",
    """select project, string_agg(trim(servicio), ', ' order by trim(servicio)) as services,
      round(least(sum(completion_percent::decimal(28,6))::double / count(*), 1.0), 6) as completion_percent,
      sum(bid_price)::double as bid_price, sum(labor_budget_original)::double as labor_budget_original,
      sum(labor_paid)::double as labor_paid, sum(materials_budget_original)::double as materials_budget_original,
      sum(materials_paid)::double as materials_paid, sum(budget_days)::bigint as budget_days,
      sum(used_days)::bigint as used_days, sum(hours_registered)::bigint as hours_registered
    from project_control_export group by project""",
)
def project_rollup(t: Tables):
    return C.project_rollup(t.view("project_control_export"))


@query(
    "project_services",
    "select trim(project) as project, trim(servicio) as servicio, count(*) as n from project_control_export group by 1, 2",
)
def project_services(t: Tables):
    return C.project_services(t.view("project_control_export"))


STEPS["payroll_steps"] = f"""
select *, lower(trim(substr(replace(memo, 'ACH DEBIT ', ''), 1, 8))) as text from payroll_ledger
where regexp_matches(name, '{VENDOR}') and amount > 0 and date between '{PAY_WINDOW[0]}' and '{PAY_WINDOW[1]}'
  and not regexp_matches(account, 'Fees') and regexp_matches(account, 'DL')"""
STEPS["payroll"] = """
select date, type, name, account, split, amount, memo, case when text like '%tax%' then 'tax' when text like '%wage%' then 'wage'
  when text like '%fees%' then 'fees' when text like '%payr%' then 'fees' else text end as concept from payroll_steps"""


def _payroll(t: Tables):
    return Q.payroll_rows(t.view("payroll_ledger"), VENDOR, *PAY_WINDOW, memo_prefix="ACH DEBIT ")


@query("payroll_rows", "select * replace (amount::double as amount) from payroll")
def payroll_rows(t: Tables):
    return _payroll(t)


@query(
    "payroll_concepts",
    """select concept, count(*) as count, sum(amount)::double as amount from payroll group by 1
    union all select 'Total', count(*), sum(amount)::double from payroll""",
)
def payroll_concepts(t: Tables):
    return Q.payroll_concepts(_payroll(t))


_WAGES = "from payroll where memo like '%WAGE PAY%'"


@query(
    "wages_with_total",
    f"""select cast(date as varchar) as date, amount::double as amount {_WAGES}
    union all select 'Total', sum(amount)::double {_WAGES}""",
)
def wages_with_total(t: Tables):
    return Q.wages_with_total(_payroll(t))


@query(
    "wages_summary",
    f"""select count(*) as n, min(date) as first_day, max(date) as last_day, min(amount)::double as minimum,
      round(quantile_cont(amount::double, 0.25), 6) as first_quartile, round(quantile_cont(amount::double, 0.5), 6) as median,
      round(avg(amount)::double, 6) as mean, round(quantile_cont(amount::double, 0.75), 6) as third_quartile,
      max(amount)::double as maximum {_WAGES}""",
)
def wages_summary(t: Tables):
    return Q.wages_summary(_payroll(t))


@query(
    "payroll_file_by_date",
    """select cast(date as varchar) as date, sum(net_paid)::double as amount from payroll_file group by 1
    union all select 'Total', sum(net_paid)::double from payroll_file""",
)
def payroll_file_by_date(t: Tables):
    return Q.payroll_file_by_date(t.view("payroll_file"))


@query(
    "payroll_proof",
    """select coalesce(w.date, f.date) as date, n, amount::double as amount, net_paid::double as net_paid,
      coalesce(amount = net_paid, false) as matching from (
        select date, count(*) as n, sum(amount) as amount from payroll where memo like '%WAGE PAY%' group by 1) w
    full join (select date, sum(net_paid) as net_paid from payroll_file group by 1) f on w.date = f.date""",
)
def payroll_proof(t: Tables):
    return Q.payroll_proof(_payroll(t), t.view("payroll_file"))
