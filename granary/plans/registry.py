"""Every registered query of the library, by name, and the SQL that gives the same rows."""

from . import cohort_plans, fit_plans, item_plans, label_plans, metric_plans, report_plans, rollout_plans, signal_plans, source_plans, stream_plans  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
