"""Column expressions that carry the null, text and date rules of the reports.

The reports distinguish an unknown value from a false one: an unguarded sum over
an unknown amount is unknown, a text test on an unknown text is false, a
conditional on an unknown condition is unknown.  Every expression below is a
built-in Catalyst expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Amounts as they are read: six decimals, far below a cent, and 22 digits before the point.
MONEY = "decimal(28,6)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: Column | str) -> Column:
    """Exact money; text that is no number becomes null, a number beyond the type is an error.

    What stands behind the sixth decimal is rounded half up.
    """
    text = _col(value)
    exact, number = text.try_cast(MONEY), text.try_cast("double")
    is_number = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    too_large = F.raise_error(F.concat(F.lit("amount out of range: "), text.cast("string"))).cast(MONEY)
    return F.when(exact.isNotNull(), exact).when(is_number, too_large)


# -- null rules ---------------------------------------------------------------


def matches(value: Column | str, pattern: str) -> Column:
    """Regex test that is false, never null, on a null text."""
    return F.coalesce(_col(value).rlike(pattern), F.lit(False))


def if_known(condition: Column, yes, no) -> Column:
    """Conditional that stays null where the condition is null."""
    return F.when(condition.isNull(), None).when(condition, yes).otherwise(no)


def total_or_null(value: Column | str) -> Column:
    """Sum that is null as soon as one input is null."""
    value = _col(value)
    return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))


def total_or_zero(value: Column | str) -> Column:
    """Sum that skips nulls and is zero over no rows."""
    return F.coalesce(F.sum(_col(value)), F.lit(0))


def total(value: Column | str, skip_missing: bool) -> Column:
    return total_or_zero(value) if skip_missing else total_or_null(value)


def total_where(condition: Column, value: str, skip_missing: bool = False) -> Column:
    """Sum of the rows that fit, null when none do: a pivot cell without the pivot's second pass."""
    fitting = F.when(condition, F.col(value))
    needed = F.count_if(condition)
    if skip_missing:
        return F.when(needed > 0, F.coalesce(F.sum(fitting), F.lit(0)))
    return F.when(needed == F.count(fitting), F.sum(fitting))


# -- text ---------------------------------------------------------------------


def tidy_text(value: Column | str) -> Column:
    """Trim all white space, tabs and line breaks included."""
    return F.trim(_col(value), F.lit(" \t\n\r\f\v"))


def nth_piece(value: Column | str, separator: str, position: int) -> Column:
    """Piece ``position`` (from 0) of a separated text, null when there is none."""
    return F.get(F.split(_col(value), separator, -1), F.lit(position))


def separate(df: DataFrame, column: str, into: Sequence[str], separator: str = ":") -> DataFrame:
    """Split one column into several: surplus pieces drop, missing ones are null."""
    pieces = {name: nth_piece(column, separator, i) for i, name in enumerate(into)}
    out: list[Column] = []
    for name in df.columns:
        if name == column:
            out += [piece.alias(new) for new, piece in pieces.items()]
        elif name not in pieces:
            out.append(F.col(name))
    return df.select(*out)


def drop_first_match(value: Column | str, pattern: str, replacement: str = "") -> Column:
    """Replace only the first match of ``pattern``."""
    return F.regexp_replace(_col(value), rf"(?s)^(.*?)(?:{pattern})", f"$1{replacement}")


def clean_name(name: str, case: str = "snake") -> str:
    """A plain ASCII name: accents dropped, signs spelled out, words split at capitals, no leading digit."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    plain = plain.replace("%", " percent ").replace("#", " number ")
    words = re.findall(r"[A-Z]+(?![a-z])\d*|[A-Z]?[a-z]+\d*|\d+", plain)
    if words and words[0][0].isdigit():
        words[0] = f"x{words[0]}"
    if case == "title":
        return " ".join(word.capitalize() for word in words)
    return "_".join(word.lower() for word in words)


def clean_names(df: DataFrame, case: str = "snake") -> DataFrame:
    """Normalise column names; a repeated name gets a running number."""
    seen: dict[str, int] = {}
    names = []
    for name in df.columns:
        new = clean_name(name, case)
        seen[new] = seen.get(new, 0) + 1
        names.append(new if seen[new] == 1 else f"{new}_{seen[new]}")
    return df.toDF(*names)


def map_columns(df: DataFrame, change: Callable[[Column], Column], kind: type = T.StringType) -> DataFrame:
    """Apply one expression to every column of a type."""
    return df.select(
        *[
            change(F.col(f.name)).alias(f.name) if isinstance(f.dataType, kind) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# -- dates --------------------------------------------------------------------


def parse_day(value: Column | str, *formats: str) -> Column:
    """First format that reads the text wins, row by row."""
    return F.coalesce(*[F.try_to_date(_col(value), fmt) for fmt in formats])


def serial_day(value: Column | str, origin: str = "1899-12-30") -> Column:
    """Spreadsheet day number to date."""
    return F.date_add(F.lit(origin).cast("date"), _col(value).cast("int"))


def first_day_of_month(value: Column | str) -> Column:
    return F.trunc(_col(value), "MM")


def last_day_of_previous_month(value: Column | str) -> Column:
    return F.last_day(F.add_months(_col(value), -1))


def year_month(value: Column | str) -> Column:
    return first_day_of_month(value)


def quarter_label(value: Column | str) -> Column:
    value = _col(value)
    return F.concat(F.year(value).cast("string"), F.lit(" Q"), F.quarter(value).cast("string"))


def month_label(value: Column | str) -> Column:
    """Month as a column-name friendly text such as ``jan_2021``."""
    return F.lower(F.date_format(_col(value), "MMM_yyyy"))
