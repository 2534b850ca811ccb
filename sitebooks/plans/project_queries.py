"""Named queries: project costing."""

from __future__ import annotations

from ..operators import projects as J
from .registry import AS_OF, STEPS, Tables, query

CLUES = ["BUILD", "MACH", "AUTO", "no such project"]
INTEREST = "BUILD|MACH|HOUSE"
FOCUS = "BUILD|MACH|AUTO"
NAMES = {"BUILDING": "Main Building", "MACHINERY": "Machine Hall"}
ALIASES = (("BUILD", "Main Building"), ("MACH", "Machine Hall"))
_COST = "regexp_matches(account, 'Indirect|Labor|Direct Material|Fees|Services|Officer')"
_INCOME = "type = 'Invoice' and regexp_matches(account, '.Operational|Material')"
_ALL = "case when count(*) = count(amount) then sum(amount) end"
_ROWS = ("date", "type", "num", "name", "class", "customer", "account", "amount")


def _piece(column: str, separator: str, n: int) -> str:
    """Piece n of a text split at a regex, null when there is none."""
    return f"regexp_split_to_array({column}, '{separator}')[{n}]"


STEPS["pclue"] = "select unnest(['BUILD', 'MACH', 'AUTO', 'no such project']) as clue"
STEPS["pcost"] = f"select clue, l.* from ledger l join pclue on regexp_matches(customer, clue) where {_COST}"
STEPS["pincome"] = f"select clue, l.* from ledger l join pclue on regexp_matches(customer, clue) where {_INCOME}"
STEPS["recent"] = """
select client as customer, project, n, volume, trim(substr(project, 1, 9)) as project_name,
  regexp_replace(regexp_replace(lower(substr(project, 1, 9)), ' ', '_') || '.xlsx', ' ', '') as file_name from (
  select split_part(customer, ':', 1) as client,
    case when customer like '%:%' then split_part(customer, ':', 2) else customer end as project,
    count(*) as n, sum(coalesce(amount, 0)) as volume from ledger
  where customer is not null and date >= '2001-10-05' group by customer) r"""
STEPS["recent_names"] = "select distinct project_name from recent"
STEPS["flow"] = f"""
select r.project_name as project, l.* replace (-amount as amount), 'OUT' as direction
from ledger l join recent_names r on contains(l.customer, r.project_name) where {_COST}
union all select r.project_name as project, l.*, 'IN' from ledger l join recent_names r on contains(l.customer, r.project_name)
where {_INCOME}"""
STEPS["levels"] = f"""
select date, {_piece('account', '[.?:]', 1)} as main, {_piece('account', '[.?:]', 2)} as second, class,
  -({{agg}}) as amount, 'outflow' as direction, project from (
    select r.project_name as project, l.* from ledger l join focus_names r on contains(l.customer, r.project_name)
    where {_COST}) o group by project, date, account, class
union all select date, split_part(account, ':', 1), num, {_piece('account', ':', 2)}, {{agg}}, 'inflow', project from (
    select r.project_name as project, l.* from ledger l join focus_names r on contains(l.customer, r.project_name)
    where {_INCOME}) i group by project, date, account, num"""
STEPS["focus_names"] = f"select distinct project_name from recent where regexp_matches(project, '{FOCUS}')"
STEPS["levels_known"] = STEPS["levels"].replace("{agg}", "coalesce(sum(amount), 0)")
STEPS["levels"] = STEPS["levels"].replace("{agg}", _ALL)
_CONSOLIDATED = """
select date, main, coalesce(second, main) as second, class, amount, direction,
  case project when 'BUILDING' then 'Main Building' when 'MACHINERY' then 'Machine Hall' end as project,
  case when coalesce(second, main) like '%Materials%' then 'Materials' when coalesce(second, main) like '%Labor%' then 'Labor'
    when coalesce(second, main) like '%Supplies%' then 'Materials' when coalesce(second, main) like '%Tools%' then 'Materials'
    when coalesce(second, main) like '%Fees%' then 'Materials' when coalesce(second, main) like '%S00%' then 'Invoice'
    else coalesce(second, main) end as concept from """
STEPS["consolidated"] = _CONSOLIDATED + "levels"
STEPS["consolidated_known"] = _CONSOLIDATED + "levels_known"
_MONEY = "* replace (amount::double as amount)"


@query("project_expenses", f"select clue, date, type, num, name, class, customer, account, amount::double as amount from pcost")
def project_expenses(t: Tables):
    return J.project_expenses(t.ledger(*_ROWS), CLUES)


@query("project_incomes", "select clue, date, type, num, name, class, customer, account, amount::double as amount from pincome")
def project_incomes(t: Tables):
    return J.project_incomes(t.ledger(*_ROWS), CLUES)


@query("expenses_daily", f"select clue, customer, date, ({_ALL})::double as amount from pcost group by 1, 2, 3")
def expenses_daily(t: Tables):
    return J.expenses_daily(J.project_expenses(t.ledger("date", "customer", "account", "amount"), CLUES))


@query(
    "grouped_expenses",
    f"""with g as (select clue, {_piece('account', '[.?:]', 1)} as main, {_piece('account', '[.?:]', 2)} as second,
        {_piece('account', '[.?:]', 3)} as third, coalesce(sum(amount), 0)::double as amount from pcost group by clue, account),
      s as (select clue, case when main = 'Cost of Goods Sold' then second else main end as second, third, amount from g)
    select clue, second, third, amount,
      case when second like '%Direct%' then 'Cost' when second like '%Indirect%' then 'Expense' end as main from s""",
)
def grouped_expenses(t: Tables):
    costs = J.project_expenses(t.ledger("customer", "account", "amount"), CLUES)
    return J.grouped_expenses(costs, skip_missing=True)


@query(
    "grouped_incomes",
    f"""select clue, split_part(account, ':', 1) as main, {_piece('account', ':', 2)} as second, num, ({_ALL})::double as amount
    from pincome group by clue, account, num""",
)
def grouped_incomes(t: Tables):
    return J.grouped_incomes(J.project_incomes(t.ledger("type", "num", "customer", "account", "amount"), CLUES))


@query(
    "expenses_level",
    f"""select clue, date, {_piece('account', '[.?:]', 1)} as main, {_piece('account', '[.?:]', 2)} as second, class,
      ({_ALL})::double as amount from pcost group by clue, date, account, class""",
)
def expenses_level(t: Tables):
    return J.expenses_level(J.project_expenses(t.ledger("date", "class", "customer", "account", "amount"), CLUES))


@query(
    "incomes_level",
    f"""select clue, date, split_part(account, ':', 1) as main, num as second, {_piece('account', ':', 2)} as class,
      ({_ALL})::double as amount from pincome group by clue, date, account, num""",
)
def incomes_level(t: Tables):
    return J.incomes_level(J.project_incomes(t.ledger("date", "type", "num", "customer", "account", "amount"), CLUES))


@query(
    "vendor_client",
    """select date, name, customer, account, amount::double as amount from ledger
    where regexp_matches(name, 'Supplier') and regexp_matches(customer, 'BUILD')""",
)
def vendor_client(t: Tables):
    rows = t.ledger("date", "name", "customer", "account", "amount")
    return J.vendor_client(rows, "Supplier", "BUILD")


@query(
    "invoices_by_project",
    """select num, date, name, project_name, amount::double as amount, open_balance::double as open_balance from invoices
    where regexp_matches(project_name, 'HOUSE')""",
)
def invoices_by_project(t: Tables):
    rows = t.view("invoices").select("num", "date", "name", "project_name", "amount", "open_balance")
    return J.invoices_by_project(rows, "HOUSE")


@query("type_counts", "select type, count(*) as n from ledger group by 1 union all select 'Total', count(*) from ledger")
def type_counts(t: Tables):
    return J.type_counts(t.ledger("type"))


def _recent(t: Tables):
    return J.recent_projects(t.ledger("date", "customer", "amount"), AS_OF)


@query("recent_projects", "select * replace (volume::double as volume) from recent")
def recent_projects(t: Tables):
    return _recent(t)


@query("recent_project_names", "select file_name, count(*) as n from recent group by 1")
def recent_project_names(t: Tables):
    return J.recent_project_names(_recent(t))


@query(
    "recent_volume",
    f"""select customer, count(*) as n, ({_ALL})::double as amount from ledger where date >= '2001-10-26'
      and customer is not null group by 1 having ({_ALL}) <> 0""",
)
def recent_volume(t: Tables):
    return J.recent_volume(t.ledger("date", "customer", "amount"), AS_OF)


@query(
    "project_cashflow",
    "select project, direction, date, type, num, name, class, customer, account, amount::double as amount from flow",
)
def project_cashflow(t: Tables):
    return J.project_cashflow(t.ledger(*_ROWS), _recent(t))


@query(
    "clue_table_cashflow",
    f"""select project, direction, date, type, num, name, class, customer, account, amount::double as amount from (
      select clue as project, 'OUT' as direction, l.* replace (-amount as amount) from ledger l
        join clue_table on regexp_matches(l.customer, clue) where {_COST}
      union all select clue, 'IN', l.* from ledger l join clue_table on regexp_matches(l.customer, clue) where {_INCOME}) f""",
)
def clue_table_cashflow(t: Tables):
    clues = t.view("clue_table").withColumnRenamed("clue", "project_name")
    return J.project_cashflow(t.ledger(*_ROWS), clues, regex=True)


@query(
    "project_status",
    """with s as (select r.file_name, sum(f.amount) as status from flow f
      join (select project_name, min(file_name) as file_name from recent group by 1) r on f.project = r.project_name group by 1)
    select r.customer, r.project, r.volume::double as volume, r.project_name, file_name, s.status::double as status
    from recent r left join s using (file_name)""",
)
def project_status(t: Tables):
    return J.project_status(t.ledger("type", "customer", "account", "amount"), _recent(t), skip_missing=True)


def _levels(t: Tables, skip_missing: bool):
    focus = _recent(t).where(J.matches("project", FOCUS))
    return J.cashflow_levels(t.ledger(*_ROWS), focus, skip_missing)


@query("cashflow_levels", f"select {_MONEY} from levels")
def cashflow_levels(t: Tables):
    return _levels(t, skip_missing=False)


@query("cashflow_consolidated", f"select {_MONEY} from consolidated")
def cashflow_consolidated(t: Tables):
    return J.cashflow_consolidated(_levels(t, skip_missing=False), NAMES)


@query(
    "cashflow_by_day",
    f"""select date, project, concept, class, direction, ({_ALL})::double as amount from consolidated
    group by date, project, concept, class, direction""",
)
def cashflow_by_day(t: Tables):
    return J.cashflow_sums(J.cashflow_consolidated(_levels(t, skip_missing=False), NAMES), by_date=True)


@query(
    "cashflow_resume",
    """select project, concept, class, direction, sum(amount)::double as amount from consolidated_known
    group by project, concept, class, direction""",
)
def cashflow_resume(t: Tables):
    full = J.cashflow_consolidated(_levels(t, skip_missing=True), NAMES)
    return J.cashflow_sums(full, by_date=False, skip_missing=True)


@query(
    "cashflow_by_project",
    """select project, sum(amount)::double as amount from consolidated_known group by project
    union all select 'Total', sum(amount)::double from consolidated_known""",
)
def cashflow_by_project(t: Tables):
    full = J.cashflow_consolidated(_levels(t, skip_missing=True), NAMES)
    return J.cashflow_by_project(full, skip_missing=True)


_CONCEPT = """case when account like '%Materials%' then 'Materials' when account like '%Labor%' then 'Labor'
  when account like '%Supplies%' then 'Materials' when account like '%Tools%' then 'Materials'
  when account like '%Fees%' then 'Materials' when account like '%S00%' then 'Invoice' else account end"""


@query(
    "open_project_costs",
    f"""select case when project like '%BUILD%' then 'Main Building' when project like '%MACH%' then 'Machine Hall'
      else project end as project, class, {_CONCEPT} as concept, coalesce(sum(amount), 0)::double as amount
    from (select *, {_piece('customer', ':', 2)} as project from ledger) l
    where {_COST} and regexp_matches(customer, '{INTEREST}') group by 1, 2, 3""",
)
def open_project_costs(t: Tables):
    rows = t.ledger("customer", "class", "account", "amount")
    return J.project_costs(rows, INTEREST, ALIASES, skip_missing=True)


@query(
    "open_project_cost_lines",
    f"""select date, case when project like '%BUILD%' then 'Main Building' when project like '%MACH%' then 'Machine Hall'
      else project end as project, class, {_CONCEPT} as concept, amount::double as amount
    from (select *, {_piece('customer', ':', 2)} as project from ledger) l
    where {_COST} and regexp_matches(customer, '{INTEREST}')""",
)
def open_project_cost_lines(t: Tables):
    rows = t.ledger("date", "customer", "class", "account", "amount")
    return J.project_cost_lines(rows, INTEREST, ALIASES)


@query(
    "project_cost_lines_since",
    f"""select date, {_piece('customer', ':', 2)} as project, class, {_CONCEPT} as concept, amount::double as amount
    from ledger where {_COST} and date between '2001-09-10' and '{AS_OF}'""",
)
def project_cost_lines_since(t: Tables):
    rows = t.ledger("date", "customer", "class", "account", "amount")
    return J.project_cost_lines(rows, first="2001-09-10", last=AS_OF)


@query(
    "project_costs_since",
    f"""select {_piece('customer', ':', 2)} as project, class, {_CONCEPT} as concept, ({_ALL})::double as amount
    from ledger where {_COST} and date between '2001-09-10' and '{AS_OF}' group by 1, 2, 3""",
)
def project_costs_since(t: Tables):
    rows = t.ledger("date", "customer", "class", "account", "amount")
    return J.project_costs(rows, first="2001-09-10", last=AS_OF)


@query(
    "phase_costs",
    """select clue, date, account, case class when 'SMALL' then 'Small works' else class end as class, amount::double as amount,
      case when account like '%Materials%' then 'Materials' when account like '%Supplies%' then 'Materials'
        when account like '%Labor%' then 'Labor' else account end as concept,
      case when date <= '1998-03-25' then '1st' else '2nd' end as phase from pcost""",
)
def phase_costs(t: Tables):
    costs = J.project_expenses(t.ledger("date", "class", "customer", "account", "amount"), CLUES)
    return J.phase_costs(costs, "1998-03-25", {"SMALL": "Small works"})


@query(
    "prior_buckets",
    """with g as (select name, case when date < '1998-03-31' then 'Prior to 1998-03-31' else 'Prior to 2001-12-31' end
      as date_reference, coalesce(sum(amount), 0) as amount from ledger where regexp_matches(account, '(IL)') group by 1, 2)
    select * replace (amount::double as amount) from g union all select 'Total', '-', sum(amount)::double from g""",
)
def prior_buckets(t: Tables):
    rows = t.ledger("date", "name", "account", "amount")
    return J.prior_buckets(rows, "(IL)", "1998-03-31", "2001-12-31", skip_missing=True)


@query(
    "invoiced_by_service",
    f"""with g as (select clue, {_piece('customer', ':', 2)} as project, num, {_piece('account', ':', 2)} as service,
        {_ALL} as amount from ledger join pclue on regexp_matches(customer, clue)
      where regexp_matches(type, 'Invoice') and regexp_matches(split, 'Accounts R') and account is not null group by 1, 2, 3, 4)
    select * replace (amount::double as amount) from g
    union all select clue, 'Total', '-', '-', coalesce(sum(amount), 0)::double from g group by clue""",
)
def invoiced_by_service(t: Tables):
    return J.invoiced_by_service(t.ledger("type", "split", "num", "customer", "account", "amount"), CLUES)


@query(
    "assumed_costs",
    f"""with g as (select clue, {_piece('customer', ':', 2)} as project,
        case when account like '%Direct Labor%' then 'labor' when account like '%Direct Material%' then 'materials' end as source,
        class, coalesce(sum(amount), 0) as amount from ledger join pclue on regexp_matches(customer, clue)
      where account like '%Direct Labor%' or account like '%Direct Material%' group by 1, 2, 3, 4)
    select * replace (amount::double as amount) from g
    union all select clue, 'Total', '-', '-', coalesce(sum(amount), 0)::double from g group by clue""",
)
def assumed_costs(t: Tables):
    return J.assumed_costs(t.ledger("class", "customer", "account", "amount"), CLUES, skip_missing=True)
