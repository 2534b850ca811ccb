from .base_tables import table
from .business_views import ledger, view, with_views
from .readers import (
    first_rows,
    read_database,
    read_folder,
    read_named_sheet,
    read_records,
    read_report_export,
    read_sheet,
    read_takeoff_csv,
    sql_over,
    with_source_line,
)
from .runs import current_run, publish_run, read_run
from .snapshots import bag_delta, changed_parts, snapshot_changes, write_counted_snapshot
from .writers import write_per_key, write_snapshot, write_table, write_workbook

__all__ = [
    "bag_delta",
    "changed_parts",
    "current_run",
    "first_rows",
    "ledger",
    "publish_run",
    "read_database",
    "read_folder",
    "read_named_sheet",
    "read_records",
    "read_report_export",
    "read_run",
    "read_sheet",
    "read_takeoff_csv",
    "snapshot_changes",
    "sql_over",
    "table",
    "view",
    "with_source_line",
    "with_views",
    "write_counted_snapshot",
    "write_per_key",
    "write_snapshot",
    "write_table",
    "write_workbook",
]
