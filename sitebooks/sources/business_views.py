"""Business tables (ledger, invoices, take-off ...) derived from the star schema.

Each view is a SQL text both Spark and the checking engine can run, so that both
start from the same rows.  The ledger is the exception on the Spark side: it joins
only the dimensions that the wanted columns need, because an inner join cannot be
dropped by the optimiser.  Money is cast to decimal before any arithmetic.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base_tables import SCHEMAS, table

_TYPE = (
    "case when l_returnflag = 'A' then 'Invoice' when l_returnflag = 'N' and l_linestatus = 'F' then 'Bill' "
    "when l_returnflag = 'N' then 'Expense' when l_linestatus = 'F' then 'Payment' else 'Credit Memo' end"
)
_FULL_NAME = "c_name || ':' || c_mktsegment"
_ACCOUNT = f"""case
  when l_returnflag = 'A' then case
    when p_type in ('MEDIUM', 'STANDARD') then '4.Operational Income:' || p_brand
    when p_type in ('LARGE', 'PROMO') then '4.Material Income:Materials Income'
    when p_type = 'SMALL' and p_size % 10 = 0 then '4.Operational Income:Billable Extras'
    when p_type = 'SMALL' then 'Billable Expense Income'
    else 'Accounts Receivable (A/R)' end
  when l_returnflag = 'N' and l_linestatus = 'F' then case
    when p_type in ('MEDIUM', 'STANDARD') then 'Cost of Goods Sold:Direct Labor (DL):' || p_brand
    when p_type in ('LARGE', 'PROMO') then 'Cost of Goods Sold:Direct Materials (DM):Supplies'
    when p_type = 'SMALL' then 'Indirect Labor (IL)' end
  when l_returnflag = 'N' then case p_type
    when 'MEDIUM' then 'Automobile Expense:Fuel'
    when 'STANDARD' then 'Insurance Expense:Workers Comp'
    when 'LARGE' then 'Office Expenses'
    when 'PROMO' then 'Professional Fees'
    when 'SMALL' then 'Other Expenses:Storage Rent'
    else 'Ask Accountant' end
  when l_linestatus = 'F' then 'Undeposited Funds'
  else 'Accounts Receivable (A/R)' end"""

# ledger column -> (expression, dimensions it needs)
LEDGER = {
    "date": ("cast(l_shipdate as date)", ""),
    "type": (_TYPE, ""),
    "num": ("'S' || lpad(cast(l_orderkey as string), 7, '0')", ""),
    "name": (
        f"case when l_returnflag = 'N' then case when s_suppkey % 11 <> 0 then s_name end else {_FULL_NAME} end",
        "orders customer supplier",
    ),
    "memo": ("p_name", "part"),
    "class": ("p_type", "part"),
    "customer": (
        f"case when c_custkey % 17 = 0 then null when c_custkey % 13 = 0 then c_name else {_FULL_NAME} end",
        "orders customer",
    ),
    "account": (_ACCOUNT, "part"),
    "split": ("case when l_returnflag = 'A' then 'Accounts Receivable (A/R)' else 'Checking' end", ""),
    "amount": ("case when l_linenumber <> 7 then cast(l_extendedprice as decimal(18,2)) end", ""),
    "creation_date": ("l_shipdate", ""),
    "modification_date": ("o_orderdate", "orders"),
}
# further columns some views below need; not part of the ledger itself
_EXTRA = {
    "x_project": ("c_mktsegment", "orders customer"),
    "x_suppkey": ("s_suppkey", "supplier"),
    "x_supplier": ("s_name", "supplier"),
    "x_partkey": ("p_partkey", "part"),
    "x_line": ("l_linenumber", ""),
}
_JOINS = {
    "orders": ("o_orderkey", "l_orderkey"),
    "customer": ("c_custkey", "o_custkey"),
    "supplier": ("s_suppkey", "l_suppkey"),
    "part": ("p_partkey", "l_partkey"),
}


def ledger(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The transaction ledger, narrowed to ``columns`` (all when none are named)."""
    known = LEDGER | _EXTRA
    columns = columns or tuple(LEDGER)
    needed = set(" ".join(known[c][1] for c in columns).split())
    # short forms of what is only read as such, before the lines are shuffled
    early = [c for c in ("date", "amount") if c in columns]
    lines = table(spark, folder, "lineitem").withColumns({f"__{c}": F.expr(known[c][0]) for c in early})
    # parts come first, since most filters are on accounts; names and customers are the widest texts and meet the
    # orders, not the lines
    sides = {name: table(spark, folder, name) for name in _JOINS if name in needed}
    if "customer" in sides:
        right, left = _JOINS["customer"]
        customer = sides.pop("customer")
        sides["orders"] = sides["orders"].join(customer, F.col(left) == F.col(right))
    for name in ("part", "supplier", "orders"):
        if name in sides:
            right, left = _JOINS[name]
            lines = lines.join(sides[name], F.col(left) == F.col(right))
    return lines.select(*[(F.col(f"__{c}") if c in early else F.expr(known[c][0])).alias(c) for c in columns])


def _ledger_sql(columns: dict) -> str:
    picked = ", ".join(f"{expr} as {name}" for name, (expr, _) in columns.items())
    joins = " ".join(f"join {n} on {r} = {l}" for n, (r, l) in _JOINS.items())
    return f"select {picked} from lineitem {joins}"


_NOUN = "split_part(p_name, ' ', 2)"
_ADJECTIVE = "split_part(p_name, ' ', 1)"
_MONTH_FIRST = (
    "lpad(cast(month({0}) as string), 2, '0') || '/' || lpad(cast(day({0}) as string), 2, '0') "
    "|| '/' || cast(year({0}) as string)"
)
_YEAR_FIRST = (
    "cast(year({0}) as string) || '-' || lpad(cast(month({0}) as string), 2, '0') || '-' "
    "|| lpad(cast(day({0}) as string), 2, '0')"
)

# view -> (text, ledger columns the text reads; empty when it reads none)
VIEWS: dict[str, tuple[str, str]] = {
    # what the accounting system exports: everything is text, subtotal lines have no date
    "raw_export": (
        "select case when account is not null then ' ' || shipped end as date, "
        "type || ' ' as transaction_type, num, name, memo as memo_description, ' ' || account as account, split, "
        "coalesce(cast(amount as string), '-') as amount, customer, class, "
        "shipped || ' 10:20:30' as create_date, ordered || ' 01:02:03' as last_modified from (select *, "
        f"{_MONTH_FIRST.format('creation_date')} as shipped, {_MONTH_FIRST.format('modification_date')} as ordered "
        "from ledger) e",
        "type num name memo account split amount customer class creation_date modification_date",
    ),
    "expense_report": (
        "select account from ledger where type = 'Expense' and account <> 'Other Expenses:Storage Rent'",
        "type account",
    ),
    "invoices": (
        "select 'Invoice' as type, 'S' || lpad(cast(o_orderkey as string), 7, '0') as num, "
        "cast(o_orderdate as date) as date, cast(o_orderdate as date) + 30 as due_date, "
        f"{_FULL_NAME} as name, c_mktsegment as project_name, cast(o_totalprice as decimal(18,2)) as amount, "
        "case o_orderstatus when 'F' then cast(0 as decimal(18,2)) when 'O' then cast(o_totalprice as decimal(18,2)) "
        "else cast(cast(o_totalprice as decimal(18,2)) - cast(100 as decimal(18,2)) as decimal(18,2)) end as open_balance, "
        "o_orderpriority as x_priority from orders join customer on c_custkey = o_custkey",
        "",
    ),
    # the second system misses open low-priority invoices and books some a day late
    "invoices_b": (
        "select ' ' || num || ' ' as reference, project_name as project, amount, "
        "case when x_priority = '3-MEDIUM' then date + 1 else date end as invoice_date "
        "from invoices where not (x_priority = '5-LOW' and open_balance = amount)",
        "",
    ),
    "payments_b": (
        "select case when x_suppkey % 10 = 0 then date + 1 else date end as payment_date, "
        "case x_line % 3 when 0 then 'Expense' when 1 then 'Subcontract' else 'Hourly Labor' end as transaction_type, "
        "x_project as project, class as services, 'SC-' || lpad(cast(x_suppkey as string), 4, '0') as subcontract, "
        "case class when 'MEDIUM' then 'Drywall ' when 'STANDARD' then 'Framing ' when 'LARGE' then 'Stucco ' "
        "when 'PROMO' then 'Installation ' when 'SMALL' then 'Finish ' else 'Painting ' end as subcontract_name, "
        "x_supplier as resource, case when x_partkey % 50 = 0 then cast(amount + cast(0.01 as decimal(18,2)) "
        "as decimal(18,2)) else amount end as amount_paid from ledger where type = 'Bill'",
        "date type class amount x_suppkey x_line x_project x_supplier x_partkey",
    ),
    "subcontracts": (
        "select project, services as service, subcontract as subcontract_id, subcontract_name, "
        "cast(coalesce(sum(amount_paid), 0) + 1000 as decimal(18,2)) as contract_amount, count(*) as budget_days, "
        "count(distinct payment_date) as used_days, min(payment_date) as start_date "
        "from payments_b group by project, services, subcontract, subcontract_name",
        "",
    ),
    # one contract per project and subcontract id
    "contracts": (
        "select project, subcontract_id, cast(sum(contract_amount) as decimal(18,2)) as contract_amount, "
        "sum(budget_days) as budget_days from subcontracts where subcontract_name <> 'Painting ' "
        "group by project, subcontract_id",
        "",
    ),
    "labor_controls": (
        "select project, subcontract_id as controlabor_id, subcontract_name as controlabor_name, start_date, "
        "cast(contract_amount * 2 as decimal(18,2)) as bid_price, contract_amount as labor_amount, "
        "cast(contract_amount * 0.4 as decimal(20,4)) as materials, budget_days, used_days from subcontracts "
        "where service <> 'SMALL'",
        "",
    ),
    "open_projects": (
        "select distinct c_mktsegment as project from customer where c_mktsegment <> 'FURNITURE'",
        "",
    ),
    "time_logs": (
        "select case user_id % 5 when 0 then 'MACHINERY' when 1 then 'BUILDING' when 2 then 'AUTOMOBILE' "
        "when 3 then 'HOUSEHOLD' else 'FURNITURE' end as project_name, "
        "case event_type when 'signup' then 'Drywall' when 'error' then 'Maintenance' when 'click' then 'Framing' "
        "when 'view' then 'Stucco' else 'Painting' end || ' - ' || cast(user_id as string) as controlabor, "
        "event_id % 8 + 1 as duration, cast(ts as date) as task_date from events",
        "",
    ),
    "change_orders": (
        "select c_mktsegment as project, case when o_orderkey % 7 <> 0 then o_orderkey % 100 end as change_order_number, "
        "cast(o_orderdate as date) as agreement_date from orders join customer on c_custkey = o_custkey "
        "where o_orderpriority = '1-URGENT'",
        "",
    ),
    "payroll_ledger": (
        "select date, type, num, name, account, split, amount, customer, class, 'ACH DEBIT ' || case x_line when 1 then "
        "'TAX PMT' when 2 then 'WAGE PAY' when 3 then 'WAGE PAY' when 4 then 'Fees 12' when 5 then 'PAYROLL SVC' "
        "else memo end as memo from ledger",
        "date type num name account split amount customer class memo x_line",
    ),
    # what the payroll provider reports: one line per day and worker, a few of them a cent off
    "payroll_file": (
        "select date, name as worker, cast(sum(amount) + case when name like '%1' then 0.01 else 0 end as decimal(18,2)) "
        "as net_paid from payroll_ledger where type = 'Bill' and name is not null and amount > 0 "
        "and account like '%DL%' and memo like '%WAGE PAY%' group by date, name",
        "",
    ),
    "takeoff": (
        f"select case when l_linenumber = 7 then 'TOTAL' else 'Job ' || cast(l_orderkey % 50 as string) end as project, "
        "case l_returnflag when 'A' then 'Inside ' when 'N' then 'Outside' else 'Roof' end as location, "
        f"case {_NOUN} when 'ring' then 'Framing' when 'bolt' then 'drywall_installation' when 'anvil' then 'insulation' "
        "when 'widget' then 'plywood_installation' when 'gear' then 'finish' when 'gizmo' then 'stucco' "
        "when 'plate' then 'waterproofing' else case l_linestatus when 'F' then 'interior_paint' "
        "else 'exterior_paint' end end as service, lower(p_brand) as surface, "
        f"case {_ADJECTIVE} when 'small' then 'gypsum_type_x' when 'red' then 'gypsum' when 'blue' then 'durock' "
        "when 'large' then 'batt_r13' when 'new' then 'r30' else lower(p_type) end as material, "
        "lower(p_type) as texture, case when p_size % 5 = 0 then null when p_size % 2 = 0 then '20ga' else '25ga' "
        "end as design, case when p_partkey % 2 = 0 then '5/8''''' else '7/8\"' end as thickness, "
        "p_size % 3 + 1 as difficulty, case l_linestatus when 'F' then 'new' else 'repaint' end as type, "
        "l_quantity as total_sf, l_quantity / 2 as hours from lineitem join part on p_partkey = l_partkey",
        "",
    ),
    "takeoff_upload": (
        f"select 'Level ' || cast(p_size % 2 + 1 as string) as level, case when {_NOUN} in ('gizmo', 'ring', 'bolt', "
        "'gear') then 'Stucco' else 'framing' end as service, case when p_partkey % 2 = 0 then '5/8_Texture_Stucco' "
        "else '5/8_texture_stucco_wire_lath' end as material_surface, l_quantity as total_sf "
        "from lineitem join part on p_partkey = l_partkey",
        "",
    ),
    "sites": (
        "select c_custkey as site, cast(c_custkey % 90 as double) as lat, cast(-(c_custkey % 180) as double) as long "
        "from customer",
        "",
    ),
    # windows of looking for new vendors: a quarter's start, and lengths that make them overlap
    "vendor_windows": (
        "select distinct quarter_start - 31 as initial, quarter_start as future_first, quarter_start + "
        "case when month(quarter_start) = 1 then 200 else 100 end as future_last from (select "
        "cast(date_trunc('quarter', o_orderdate) as date) as quarter_start from orders) q",
        "",
    ),
    # clues that are data: regexes someone keeps in a table, with alternatives, classes and anchors
    "clue_table": (
        "select case s_suppkey % 4 when 0 then '^' || client || '[:](BUILD|MACH).+' when 1 then client || ':AUTO|' || "
        "client || ':HOUSE' when 2 then client || ':?F.*URE$' else client end as clue from (select s_suppkey, "
        "'Customer#' || lpad(cast(s_suppkey as string), 9, '0') as client from supplier) c",
        "",
    ),
    "daily_series": (
        "select cast(o_orderdate as date) as date, count(*) as value from orders group by cast(o_orderdate as date)",
        "",
    ),
    "payables": (
        "select 'S' || lpad(cast(o_orderkey as string), 7, '0') as num, cast(o_totalprice as decimal(18,2)) as amount, "
        f"case o_orderstatus when 'F' then {_YEAR_FIRST.format('o_orderdate')} else {_MONTH_FIRST.format('o_orderdate')} "
        f"end as date, case o_orderstatus when 'O' then {_YEAR_FIRST.format('o_orderdate')} when 'P' then "
        f"{_MONTH_FIRST.format('o_orderdate')} else 'n/a' end as due_date from orders",
        "",
    ),
    # payments without a subcontract, and day numbers as a spreadsheet stores them
    "payments_track": (
        "select datediff('day', date '1899-12-30', payment_date) as transaction_date, ' ' || project as project, "
        "services || ' ' as service, amount_paid from payments_b",
        "",
    ),
    "subcontract_list": (
        "select distinct case project when 'MACHINERY' then 'Machine Hall' else project end as project, "
        "services as service, max(subcontract) as subcontract_id from payments_b where services <> 'ECONOMY' "
        "group by 1, 2",
        "",
    ),
    "bank_statement": (
        "select datediff('day', date '1899-12-30', date) as fecha, coalesce(name, 'CASH') || ' INTERNAL' as descripcion, "
        "case type when 'Payment' then amount else -amount end as valor, num as documento from ledger",
        "date name type amount num",
    ),
    "bid_sheet": (
        "select 'Job ' || cast(l_orderkey % 50 as string) as proposal, l_returnflag as trade, "
        "case when l_linenumber = 7 then 'Grand_Total' else p_name end as material, case when p_size % 5 <> 0 then p_type "
        "end as unit, cast(l_extendedprice as decimal(18,2)) as price from lineitem join part on p_partkey = l_partkey",
        "",
    ),
    "project_control_export": (
        "select project, ' ' || subcontract_name as servicio, cast(contract_amount * 2 as decimal(18,2)) as bid_price, "
        "cast(used_days as double) / 4 as completion_percent, contract_amount as labor_budget_original, "
        "cast(contract_amount - 1000 as decimal(18,2)) as labor_paid, cast(contract_amount * 0.4 as decimal(20,4)) as "
        "materials_budget_original, cast((contract_amount - 1000) * 0.3 as decimal(20,4)) as materials_paid, budget_days, "
        "used_days, budget_days * 8 as hours_registered from subcontracts",
        "",
    ),
}


def _price_list() -> str:
    """Prices by the key positions each trade uses; difficulty 3 and one brand have none."""
    material = (
        f"case {_ADJECTIVE} when 'small' then 'gypsum_type_x' when 'red' then 'gypsum' when 'blue' then 'durock' "
        "when 'large' then 'batt_r13' when 'new' then 'r30' else lower(p_type) end"
    )
    alias = material.replace("'gypsum_type_x'", "'gypsum'")
    design = "case when p_size % 5 = 0 then null when p_size % 2 = 0 then '20ga' else '25ga' end"
    thickness = "case when p_partkey % 2 = 0 then '5/8\"' else '7/8\"' end"
    grade = "cast(p_size % 3 + 1 as string)"
    drywall = (
        "case p_size % 6 when 0 then 1.88 when 1 then 2.01 when 2 then 1.30 when 3 then 1.34 when 4 then 1.22 "
        "else 1.18 end"
    )
    offers = [
        ("ring", "framing", "", ""),
        ("bolt", "drywall_installation", "", ""),
        ("widget", "plywood_installation", "", ""),
        ("gear", "finish", "", ""),
        ("gizmo", "stucco", "", ""),
        *[("rod", "interior_paint", place, "new") for place in ("inside", "outside", "roof")],
        *[("rod", "exterior_paint", place, "repaint") for place in ("inside", "outside", "roof")],
    ]
    values = ", ".join(str(offer) for offer in offers)
    return (
        "select service, difficulty, texture, design, thickness, min(price) as price from (select service, "
        f"case service when 'framing' then {material} else {grade} end as difficulty, "
        f"case service when 'framing' then lower(p_brand) when 'finish' then {alias} when 'stucco' then lower(p_type) "
        "when 'interior_paint' then place when 'exterior_paint' then place end as texture, "
        f"case service when 'framing' then coalesce({design}, '20ga') when 'drywall_installation' then {alias} "
        f"when 'finish' then {design} when 'stucco' then {design} when 'interior_paint' then kind "
        "when 'exterior_paint' then kind end as design, "
        f"case when service in ('framing', 'drywall_installation', 'stucco') then {thickness} "
        "when service = 'finish' then lower(p_type) end as thickness, "
        f"cast(case service when 'drywall_installation' then {drywall} else (p_size % 40 + 100) * 0.01 end "
        "as decimal(18,2)) as price "
        f"from part join (values {values}) as v(noun, service, place, kind) on v.noun = {_NOUN} "
        "where case service when 'framing' then p_brand <> 'Brand#3' else p_size % 3 <> 2 end) p "
        "group by service, difficulty, texture, design, thickness"
    )


VIEWS["prices"] = (_price_list(), "")


def _reads(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:from|join)\s+{n}\b", text)]


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A business view as a DataFrame."""
    text, columns = VIEWS[name]
    sources: dict[str, DataFrame] = {}
    for read in _reads(text, ["ledger", *VIEWS, *SCHEMAS]):
        if read == "ledger":
            sources[read] = ledger(spark, folder, *columns.split())
        elif read in VIEWS:
            sources[read] = view(spark, folder, read)
        else:
            sources[read] = table(spark, folder, read)
    for read in sources:
        text = re.sub(rf"\b(from|join)\s+{read}\b", rf"\1 {{{read}}}", text)
    # spell the two functions that the dialects name differently
    text = text.replace("datediff('day', date '1899-12-30', ", "unix_date(date '1899-12-30') * -1 + unix_date(")
    return spark.sql(text, **sources)


def with_views(query: str, steps: dict[str, str] | None = None) -> str:
    """Prefix a checking query with the views and steps it reads, as common table expressions."""
    texts = {"ledger": _ledger_sql(LEDGER), "ledger_x": _ledger_sql(LEDGER | _EXTRA)}
    texts |= {n: re.sub(r"\b(from|join)\s+ledger\b", r"\1 ledger_x", t) for n, (t, _) in VIEWS.items()}
    texts |= steps or {}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _reads(text, texts):
            if name not in ordered and texts[name] is not text:  # a recursive step reads itself
                visit(texts[name])
                ordered.append(name)

    visit(query)
    if not ordered:
        return query
    ctes = ",\n".join(f"{n} as ({texts[n]})" for n in ordered)
    body = query.lstrip()
    if body.lower().startswith("with "):
        return f"with recursive {ctes},\n{body[5:]}"
    return f"with recursive {ctes}\n{body}"
