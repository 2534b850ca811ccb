from .columns import (
    clean_name,
    clean_names,
    drop_first_match,
    first_day_of_month,
    if_known,
    last_day_of_previous_month,
    map_columns,
    matches,
    money,
    month_label,
    nth_piece,
    parse_day,
    quarter_label,
    separate,
    serial_day,
    total,
    total_or_null,
    total_or_zero,
    total_where,
    tidy_text,
    year_month,
)
from .frames import append_total, append_total_to_rows, in_changed_parts, joined, repeated_text, sorted_text
from .intervals import in_windows
from .ordering import OrderedRows
from .quantiles import quantiles
from .matching import containing_values, matching_values, required_literals, with_clues

__all__ = [
    "OrderedRows",
    "append_total",
    "append_total_to_rows",
    "clean_name",
    "clean_names",
    "containing_values",
    "drop_first_match",
    "first_day_of_month",
    "if_known",
    "in_changed_parts",
    "in_windows",
    "joined",
    "last_day_of_previous_month",
    "map_columns",
    "matches",
    "matching_values",
    "money",
    "month_label",
    "nth_piece",
    "parse_day",
    "quantiles",
    "quarter_label",
    "repeated_text",
    "required_literals",
    "separate",
    "serial_day",
    "sorted_text",
    "tidy_text",
    "total",
    "total_or_null",
    "total_or_zero",
    "total_where",
    "with_clues",
    "year_month",
]
