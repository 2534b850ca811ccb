from . import (  # noqa: F401  (importing registers the queries)
    control_queries,
    estimate_queries,
    expense_queries,
    profit_queries,
    project_queries,
    receivable_queries,
    verb_queries,
)
from .registry import CATALOGUE, checking_sql, spark_queries

__all__ = ["CATALOGUE", "checking_sql", "spark_queries"]
