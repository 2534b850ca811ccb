"""Named queries: expenses, budget and vendors."""

from __future__ import annotations

import datetime as dt

from ..operators import expenses as X
from .registry import AS_OF, STEPS, Tables, query

SINCE = "2000-01-01"
# the months of the test tables; the operators find them in the data
MONTHS = X.month_labels(dt.date(1995, 1, 1), AS_OF)
WITHOUT = ["Fuel"]


def _first_day(label: str) -> str:
    name, year = label.split("_")
    return f"{year}-{X.month_labels(dt.date(2000, 1, 1), dt.date(2000, 12, 1)).index(f'{name}_2000') + 1:02d}-01"


_CELLS = ", ".join(
    f"coalesce(sum(amount) filter (year_month = date '{_first_day(m)}'), 0)::double as {m}" for m in MONTHS
)
_THIS = [m for m in MONTHS if m.endswith(f"_{AS_OF.year}")]
_LAST = [m for m in MONTHS if m.endswith(f"_{AS_OF.year - 1}")]
_OBSERVED = ["sep_2001", "oct_2001", "nov_2001"]
STEPS["expend"] = "select * from classified where source = 'expense'"
STEPS["matrix"] = f"""
select split_part(account, ':', 1) as main_account,
  case when account like '%:%' then split_part(account, ':', 2) else '0' end as sub_account, {_CELLS}
from expend where split_part(account, ':', 1) <> 'Ask Accountant' group by 1, 2"""
STEPS["vendor_names"] = f"""
select distinct split_part(account, ':', 1) as main_account,
  case when account like '%:%' then split_part(account, ':', 2) else account end as sub_account,
  coalesce(name, '-') as name from expend where date >= '{SINCE}' and account <> 'Ask Accountant'"""
STEPS["vendors"] = """
select main_account, sub_account, string_agg(name, ',' order by name) as vendor from vendor_names group by 1, 2"""
STEPS["complete"] = f"""
select m.main_account, v.sub_account, ({' + '.join(_LAST)}) / 12 as last_year_average, {', '.join(_THIS)}, v.vendor
from (select * replace (case when sub_account = '0' then main_account else sub_account end as sub_account) from matrix) m
join vendors v using (main_account, sub_account)"""
_ZEROS = " + ".join(f"({m} = 0)::int" for m in _OBSERVED)


@query(
    "account_vendors",
    """select *, (length(vendor) - length(replace(vendor, ',', '')) + 1)::bigint as number_vendors from vendors""",
)
def account_vendors(t: Tables):
    rows = X.expense_rows(t.ledger("date", "account", "name", "amount"), t.view("expense_report"))
    return X.account_vendors(rows, SINCE)


@query("account_vendor_names", "select * from vendor_names")
def account_vendor_names(t: Tables):
    rows = X.expense_rows(t.ledger("date", "account", "name", "amount"), t.view("expense_report"))
    return X.account_vendor_names(rows, SINCE)


def _matrix(t: Tables):
    return X.expense_matrix(t.ledger("date", "account", "amount"), t.view("expense_report"))


@query("expense_matrix", "select * from matrix")
def expense_matrix(t: Tables):
    return _matrix(t)


@query(
    "expense_budget",
    f"""select * replace (round(last_year_average, 6) as last_year_average),
      (length(vendor) - length(replace(vendor, ',', '')) + 1)::bigint as number_vendors from complete
    where sub_account in (select sub_account from complete
      where {_ZEROS} < 3 and {' + '.join(_OBSERVED)} + {_ZEROS} >= 100) and sub_account <> 'Fuel'""",
)
def expense_budget(t: Tables):
    months, report = X.vendor_months(t.ledger("date", "account", "name", "amount")), t.view("expense_report")
    matrix = X.expense_matrix(months, report, (dt.date(AS_OF.year - 1, 1, 1), AS_OF))
    vendors = X.account_vendors(X.expense_rows(months, report), SINCE)
    return X.expense_budget(matrix, vendors, AS_OF, without=WITHOUT)


@query(
    "expense_by_month",
    f"""unpivot (select main_account, {', '.join(f'sum({m}) as {m}' for m in MONTHS)} from matrix group by main_account)
    on {', '.join(MONTHS)} into name period value amount""".replace("unpivot", "with u as (unpivot", 1)
    + ") select main_account, period, round(amount, 2) as amount from u",
)
def expense_by_month(t: Tables):
    return X.expense_by_month(_matrix(t))


@query(
    "account_zoom",
    f"""select split_part(account, ':', 1) as main_account,
      case when account like '%:%' then split_part(account, ':', 2) end as sub_account,
      case when account like '%:%:%' then split_part(account, ':', 3) end as spec_account, {_CELLS},
      sum(amount)::double as all_period_sum
    from expend where split_part(account, ':', 1) <> 'Ask Accountant' group by account""",
)
def account_zoom(t: Tables):
    return X.account_zoom(t.ledger("date", "account", "amount"), t.view("expense_report"))


STEPS["months_seen"] = """
select distinct cast(date_trunc('month', date) as date) as this_month,
  cast(date_trunc('month', date) - interval 1 month as date) as initial,
  cast(cast(date_trunc('month', date) as date) - 1 + interval 1 month as date) as until from expend"""


@query(
    "new_vendors",
    """select distinct e.date, e.type, e.name, e.account, e.amount::double as amount, false as classic_vendor,
      exists (select 1 from expend a where a.name is not null and a.account = e.name and a.date <= w.initial) as classic_account,
      w.this_month as year_month
    from expend e join months_seen w on e.date between w.this_month and w.until
    where w.initial >= '1994-12-01' and e.name is not null and e.account is not null and not exists (
      select 1 from expend v where v.account is not null and v.name = e.name and v.date <= w.initial)""",
)
def new_vendors(t: Tables):
    rows = X.expense_rows(t.ledger("date", "type", "name", "account", "amount"), t.view("expense_report"))
    return X.new_vendors(rows, "1994-12-01")


@query(
    "new_vendors_in_windows",
    """select distinct w.initial, w.future_first, w.future_last, e.date, e.type, e.name, e.account, e.amount::double as amount,
      exists (select 1 from expend a where a.name is not null and a.account = e.name and a.date <= w.initial) as classic_account
    from expend e join vendor_windows w on e.date between w.future_first and w.future_last
    where e.name is not null and e.account is not null and e.amount is not null and not exists (
      select 1 from expend v where v.account is not null and v.name = e.name and v.date <= w.initial)""",
)
def new_vendors_in_windows(t: Tables):
    rows = X.expense_rows(t.ledger("date", "type", "name", "account", "amount"), t.view("expense_report"))
    return X.new_vendors_in(rows, t.view("vendor_windows"))
