"""Named queries: the text and date rules of the reports, row by row, and SQL text over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as S
from ..sources import sql_over
from .registry import Tables, query


@query(
    "text_rules",
    """select num, trim(' ' || name || ' ') as trimmed, upper(lower(class)[1]) || lower(class)[2:] as title,
      case when account is not null then regexp_replace(account, ':', ' / ') end as first_replaced,
      replace(account, ':', ' / ') as all_replaced,
      nullif(regexp_extract(customer, '[0-9]+'), '') as digits,
      len(account) - len(replace(account, ':', '')) as colons, substr(customer, 1, 9) as short_name,
      'CO000' || coalesce(name, 'NA') as pasted, regexp_split_to_array(account, ':')[2] as second_piece,
      coalesce(regexp_matches(account, 'Income'), false) as is_income,
      not coalesce(regexp_matches(account, 'Receiva'), false) as no_receivable from ledger""",
)
def text_rules(t: Tables):
    account = F.col("account")
    return t.ledger("num", "name", "class", "customer", "account").select(
        "num",
        S.tidy_text(F.concat(F.lit(" "), "name", F.lit(" "))).alias("trimmed"),
        F.initcap("class").alias("title"),
        S.drop_first_match(account, ":", " / ").alias("first_replaced"),
        F.replace(account, F.lit(":"), F.lit(" / ")).alias("all_replaced"),
        F.regexp_substr("customer", F.lit("[0-9]+")).alias("digits"),
        F.regexp_count(account, F.lit(":")).alias("colons"),
        F.substring("customer", 1, 9).alias("short_name"),
        F.concat(F.lit("CO000"), F.coalesce("name", F.lit("NA"))).alias("pasted"),
        S.nth_piece(account, ":", 1).alias("second_piece"),
        S.matches(account, "Income").alias("is_income"),
        (~S.matches(account, "Receiva")).alias("no_receivable"),
    )


@query(
    "date_rules",
    """select num, date '1899-12-30' + (date - date '1899-12-30')::int as serial_day,
      date '1899-01-01' + (date - date '1899-12-30')::int as serial_day_other_origin,
      cast(date_trunc('month', date) as date) as year_month, year(date) || ' Q' || quarter(date) as year_quarter,
      cast(date - interval 1 month as date) as month_before, cast(date + interval 1 month as date) as month_after,
      cast(date_trunc('month', date) as date) - 1 as rolled_back,
      make_date(year(date), month(date), 1) as made, (modification_date::date - date)::bigint as days,
      strftime(date, '%a') as weekday from ledger""",
)
def date_rules(t: Tables):
    date = F.col("date")
    serial = F.datediff(date, F.lit("1899-12-30").cast("date"))
    return t.ledger("num", "date", "modification_date").select(
        "num",
        S.serial_day(serial).alias("serial_day"),
        S.serial_day(serial, "1899-01-01").alias("serial_day_other_origin"),
        S.year_month(date).alias("year_month"),
        S.quarter_label(date).alias("year_quarter"),
        F.add_months(date, -1).alias("month_before"),
        F.add_months(date, 1).alias("month_after"),
        S.last_day_of_previous_month(date).alias("rolled_back"),
        F.make_date(F.year(date), F.month(date), F.lit(1)).alias("made"),
        F.datediff(F.col("modification_date").cast("date"), date).alias("days"),
        F.date_format(date, "EEE").alias("weekday"),
    )


_SQL = """
select type, count(*) as n, cast(sum(amount) as double) as amount from transactions
where account is not null group by type"""


@query("sql_text", _SQL.replace("transactions", "ledger"))
def sql_text(t: Tables):
    return sql_over({"transactions": t.ledger("type", "account", "amount")}, _SQL)
