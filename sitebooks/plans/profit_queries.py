"""Named queries: cleaning, classification, profit and period results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import total_or_zero
from ..operators import ledger as L
from ..operators import profit as P
from .registry import STEPS, Tables, query

WINDOW = ("1996-01-01", "2001-06-20")
AUDIT = ("2000-01-24", "2001-01-24")
OWN_COMPANY = "FURNITURE"
ALIASES = (("MACH", "Machine Hall"), ("BUILD", "Main Building"), ("AUTO", "Garage"), ("HOUSE", "Houses"))

STEPS["expense_set"] = (
    "select account from expense_report union select 'Automobile Expense:Leasing' "
    "union select 'Other Expenses:Storage Rent'"
)
STEPS["six_filters"] = " union all ".join(
    [
        f"select * from ledger where regexp_matches(account, '{p}')"
        for p in (".Operational Income:", "Billable", "Material Income:", "Direct Labor", "Direct Material")
    ]
    + ["select * from ledger where account in (from expense_set)"]
)
STEPS["classified"] = """
select date, type, num, name, memo, class, customer, account, split, coalesce(amount, 0) as amount, creation_date,
  cast(date_trunc('month', date) as date) as year_month, year(date) || ' Q' || quarter(date) as year_quarter,
  case when account in (from expense_set) then 'expense' when regexp_matches(account, 'Income:') then 'income'
    when regexp_matches(account, 'Billable') then 'income' when regexp_matches(account, 'Direct Labor') then 'labor_cost'
    when regexp_matches(account, 'Direct Material') then 'material_cost' else account end as source
from six_filters"""
_RESULTS = """
  round(1 - (material_cost + labor_cost)::double / nullif(income, 0)::double, 6) as operational_profit,
  round(1 - labor_cost::double / nullif(income - material_cost, 0)::double, 6) as labor_gross_profit,
  round((material_cost + labor_cost)::double / nullif(income, 0)::double, 6) as operational_cost,
  round(labor_cost::double / nullif(income - material_cost, 0)::double, 6) as labor_gross_cost,
  (income - material_cost - labor_cost)::double as difference,
  (income - material_cost - labor_cost - expenses)::double as net_result,
  (income - material_cost)::double as labor_income, (material_cost + labor_cost)::double as total_cost,
  income::double as income, material_cost::double as material_cost, labor_cost::double as labor_cost,
  expenses::double as expenses"""
_SUMS = """
  coalesce(sum(amount) filter (source = 'income'), 0) as income,
  coalesce(sum(amount) filter (source = 'material_cost'), 0) as material_cost,
  coalesce(sum(amount) filter (source = 'labor_cost'), 0) as labor_cost,
  coalesce(sum(amount) filter (source = 'expense'), 0) as expenses"""
STEPS["month_sums"] = f"select year_month, year_quarter, {_SUMS} from classified group by year_month, year_quarter"
STEPS["quarter_sums"] = f"select year_quarter, {_SUMS} from classified group by year_quarter"
STEPS["distribution"] = f"""
select type, date, account, count(*) as n, sum(coalesce(amount, 0)) as amount from (
  select type, date, amount, 'operational_income' as account from ledger where regexp_matches(account, '.Operational Income:')
  union all select type, date, amount, 'materials_income' from ledger where regexp_matches(account, 'Material Income:')
  union all select type, date, amount, 'direct_labor' from ledger where regexp_matches(account, 'Direct Labor')
  union all select type, date, amount, 'direct_material' from ledger where regexp_matches(account, 'Direct Material')
) d where date between '{WINDOW[0]}' and '{WINDOW[1]}' group by type, date, account"""


def _summary_sql(step: str) -> str:
    one = """select '{m}' as measure, min({m}::double) as minimum, round(quantile_cont({m}::double, 0.25), 6) as first_quartile,
      round(quantile_cont({m}::double, 0.5), 6) as median,
      round(sum({m}::decimal(38,10))::double / nullif(count({m}), 0), 6) as mean,
      round(quantile_cont({m}::double, 0.75), 6) as third_quartile, max({m}::double) as maximum,
      count(*) - count({m}) as missing from r"""
    rows = " union all ".join(one.format(m=m) for m in P.MEASURES)
    rounded = "round(minimum, 6) as minimum, round(maximum, 6) as maximum"
    results = _RESULTS.replace("round(", "(").replace(", 6)", ")")
    return (
        f"with r as (select {results} from {step}) "
        f"select measure, {rounded}, first_quartile, median, mean, third_quartile, missing from ({rows}) s"
    )


@query(
    "clean_ledger",
    """select cast(strptime(trim(date), '%m/%d/%Y') as date) as date, trim(transaction_type) as type, num, name,
      memo_description as memo, trim(account) as account, split, try_cast(amount as decimal(18,2))::double as amount,
      customer, class, strptime(create_date, '%m/%d/%Y %H:%M:%S') as creation_date,
      strptime(last_modified, '%m/%d/%Y %H:%M:%S') as modification_date from raw_export where date is not null""",
)
def clean_ledger(t: Tables):
    return L.clean_export(t.view("raw_export"))


_CLEANED = """cast(strptime(trim(date), '%m/%d/%Y') as date) as date, trim(transaction_type) as type, num, trim(account) as account,
  try_cast(amount as decimal(18,2))::double as amount, strptime(create_date, '%m/%d/%Y %H:%M:%S') as creation_date"""


@query(
    "clean_exports",
    f"""select 'transactions' as export, {_CLEANED} from raw_export where date is not null
    union all select 'expenses', {_CLEANED} from raw_export where date is not null and trim(transaction_type) = 'Expense'
    union all select 'invoices', {_CLEANED} from raw_export where date is not null and trim(transaction_type) = 'Invoice'""",
)
def clean_exports(t: Tables):
    raw = t.view("raw_export")
    kinds = {"transactions": raw}
    kinds |= {name: raw.where(F.trim("transaction_type") == kind) for name, kind in (("expenses", "Expense"), ("invoices", "Invoice"))}
    columns = ["export", "date", "type", "num", "account", "amount", "creation_date"]
    cleaned = [df.withColumn("export", F.lit(name)).select(*columns) for name, df in L.clean_exports(kinds).items()]
    return reduce(DataFrame.unionByName, cleaned)


@query("classified_ledger", "select * replace (amount::double as amount) from classified")
def classified_ledger(t: Tables):
    return L.classified_ledger(t.ledger(), t.view("expense_report"))


@query(
    "cost_concept",
    """select concept, short_concept, count(*) as n, sum(coalesce(amount, 0))::double as amount from (
      select amount, case when account like '%Materials%' then 'Materials' when account like '%Labor%' then 'Labor'
        when account like '%Supplies%' then 'Materials' when account like '%Tools%' then 'Materials'
        when account like '%Fees%' then 'Materials' when account like '%S00%' then 'Invoice' else account end as concept,
        case when account like '%Materials%' then 'Materials' when account like '%Supplies%' then 'Materials'
        when account like '%Labor%' then 'Labor' else account end as short_concept from ledger) c
    group by concept, short_concept""",
)
def cost_concept(t: Tables):
    account = F.col("account")
    return (
        t.ledger("account", "amount")
        .select("amount", L.cost_concept(account).alias("concept"),
                L.cost_concept(account, L.SHORT_CONCEPTS).alias("short_concept"))
        .groupBy("concept", "short_concept")
        .agg(F.count(F.lit(1)).alias("n"), total_or_zero("amount").alias("amount"))
    )


@query(
    "project_alias",
    """select project, alias, alias_or_null, count(*) as n from (select project_name as project,
      case when project_name like '%MACH%' then 'Machine Hall' when project_name like '%BUILD%' then 'Main Building'
        when project_name like '%AUTO%' then 'Garage' when project_name like '%HOUSE%' then 'Houses'
        else project_name end as alias,
      case project_name when 'FURNITURE' then 'Workshop' end as alias_or_null from invoices) a
    group by project, alias, alias_or_null""",
)
def project_alias(t: Tables):
    project = F.col("project_name")
    return (
        t.view("invoices")
        .select(
            project.alias("project"),
            L.alias_matching(project, ALIASES).alias("alias"),
            L.alias_equal(project, {"FURNITURE": "Workshop"}, keep_unlisted=False).alias("alias_or_null"),
        )
        .groupBy("project", "alias", "alias_or_null")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "payables_dates",
    """select num, amount::double as amount,
      coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%m/%d/%Y'))::date as date,
      coalesce(try_strptime(due_date, '%Y-%m-%d'), try_strptime(due_date, '%m/%d/%Y'))::date as due_date from payables""",
)
def payables_dates(t: Tables):
    return L.normalise_days(t.view("payables"))


def _monthly(t: Tables):
    return P.monthly_profit(t.ledger("date", "account", "amount"), t.view("expense_report"))


@query("monthly_profit", f"select year_month, strftime(year_month, '%Y-%m') as period, year_quarter, {_RESULTS} from month_sums")
def monthly_profit(t: Tables):
    return _monthly(t)


@query("quarterly_profit", f"select year_quarter, {_RESULTS} from quarter_sums")
def quarterly_profit(t: Tables):
    return P.quarterly_profit(_monthly(t))


@query("profit_stats_monthly", _summary_sql("month_sums"))
def profit_stats_monthly(t: Tables):
    return P.summary(_monthly(t))


@query("profit_stats_quarterly", _summary_sql("quarter_sums"))
def profit_stats_quarterly(t: Tables):
    return P.summary(P.quarterly_profit(_monthly(t)))


@query(
    "income_by_customer",
    """select year_quarter, customer, sum(amount)::double as amount from classified
    where source = 'income' and customer is not null group by 1, 2 having sum(amount) <> 0""",
)
def income_by_customer(t: Tables):
    return P.income_by_customer(t.ledger("date", "account", "amount", "customer"), t.view("expense_report"))


@query(
    "expense_by_account",
    """select year_quarter, account, sum(amount)::double as amount from classified
    where source = 'expense' group by 1, 2 having sum(amount) <> 0""",
)
def expense_by_account(t: Tables):
    return P.expense_by_account(t.ledger("date", "account", "amount"), t.view("expense_report"))


@query(
    "account_distribution",
    """select type, date, account, n, amount::double as amount, cast(date_trunc('month', date) as date) as year_month,
    year(date) || ' Q' || quarter(date) as year_quarter from distribution""",
)
def account_distribution(t: Tables):
    return P.account_distribution(t.ledger("date", "type", "account", "amount"), *WINDOW)


@query(
    "account_overview",
    "select type, account, sum(n)::bigint as count, sum(amount)::double as amount from distribution group by type, account",
)
def account_overview(t: Tables):
    return P.account_overview(P.account_distribution(t.ledger("date", "type", "account", "amount"), *WINDOW))


_INVOICED = f"""from ledger where date between '{WINDOW[0]}' and '{WINDOW[1]}' and type = 'Invoice' and amount is not null
  and not coalesce(regexp_matches(account, 'Receiva'), false)"""
_EXPENSED = f"""from ledger where date between '{WINDOW[0]}' and '{WINDOW[1]}'
  and regexp_matches(account, 'Indirect|Labor|Direct Material|Fees|Services|Officer') and customer is not null
  and not regexp_matches(customer, '{OWN_COMPANY}')"""
_SUM_ALL = "case when count(*) = count(amount) then sum(amount) end"
_FOR_PERIOD = ("date", "type", "account", "amount", "customer")


@query("period_invoiced_rows", f"select date, type, account, amount::double as amount, customer {_INVOICED}")
def period_invoiced_rows(t: Tables):
    return P.invoiced_rows(t.ledger(*_FOR_PERIOD), *WINDOW)


@query("period_invoiced", f"select customer, sum(amount)::double as amount {_INVOICED} group by customer")
def period_invoiced(t: Tables):
    return P.period_invoiced(t.ledger(*_FOR_PERIOD), *WINDOW)


@query("period_invoiced_total", f"select coalesce(sum(amount), 0)::double as amount {_INVOICED}")
def period_invoiced_total(t: Tables):
    return P.period_total(P.period_invoiced(t.ledger(*_FOR_PERIOD), *WINDOW))


@query("period_expensed_rows", f"select date, type, account, amount::double as amount, customer {_EXPENSED}")
def period_expensed_rows(t: Tables):
    return P.expensed_rows(t.ledger(*_FOR_PERIOD), *WINDOW, own_company=OWN_COMPANY)


@query("period_expensed", f"select customer, ({_SUM_ALL})::double as amount {_EXPENSED} group by customer")
def period_expensed(t: Tables):
    return P.period_expensed(t.ledger(*_FOR_PERIOD), *WINDOW, own_company=OWN_COMPANY)


@query("period_expensed_total", f"select coalesce(sum(amount), 0)::double as amount {_EXPENSED}")
def period_expensed_total(t: Tables):
    by_customer = P.period_expensed(t.ledger(*_FOR_PERIOD), *WINDOW, OWN_COMPANY, skip_missing=True)
    return P.period_total(by_customer, skip_missing=True)


@query(
    "period_result",
    f"""with inflow as (select customer, sum(amount)::double as a {_INVOICED} group by customer),
      outflow as (select customer, ({_SUM_ALL})::double as b {_EXPENSED} group by customer)
    select customer, coalesce(a, 0) as amount_invoiced, coalesce(b, 0) as amount_expensed from (
      select i.customer, a, b from inflow i left join outflow o on i.customer is not distinct from o.customer
      union select o.customer, a, b from outflow o left join inflow i on i.customer is not distinct from o.customer) r""",
)
def period_result(t: Tables):
    return P.period_result(t.ledger(*_FOR_PERIOD), *WINDOW, own_company=OWN_COMPANY)


def _audit_sql(account: str, amount: str, more: str = "") -> str:
    return (
        f"select * replace (({amount})::double as amount) from ledger where date between '{AUDIT[0]}' and '{AUDIT[1]}' "
        f"and regexp_matches(account, '{account}'){more}"
    )


@query("audit_income", _audit_sql("Income", "amount", " and type = 'Invoice'"))
def audit_income(t: Tables):
    return P.audit_extract(t.ledger(), *AUDIT, account="Income", type="Invoice", zero_missing=False)


@query("audit_direct_material", _audit_sql("(DM)", "coalesce(amount, 0)"))
def audit_direct_material(t: Tables):
    return P.audit_extract(t.ledger(), *AUDIT, account="(DM)")


@query("audit_labor", _audit_sql("Cost of Goods Sold", "coalesce(amount, 0)"))
def audit_labor(t: Tables):
    return P.audit_extract(t.ledger(), *AUDIT, account="Cost of Goods Sold")


@query("audit_cost_of_goods", _audit_sql("Cost of Goods Sold|Direct Material", "coalesce(amount, 0)"))
def audit_cost_of_goods(t: Tables):
    return P.audit_extract(t.ledger(), *AUDIT, account="Cost of Goods Sold|Direct Material")
