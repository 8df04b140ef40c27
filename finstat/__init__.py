"""Financial statements from a double-entry ledger, on Spark."""

from finstat.plans.ordered import load_sorted, save_sorted, sorted_files
from finstat.plans.rollup import change_rollup, load_rollup, refresh_rollup, rollup, save_rollup
from finstat.plans.sql_functions import register_functions
from finstat.plans.statements import (
    Statements,
    accounting_equation,
    bs_by_account,
    bs_yoy,
    financial_statements,
    line_count,
    master_classified,
    master_lines,
    pl_by_year,
    pl_one_year,
    pl_yoy,
    section_crosstab,
    section_names,
    section_totals,
    statement_rows,
)
from finstat.sources import (
    Ledger,
    from_files,
    from_parquet,
    from_tables,
    ledger,
    load_buckets,
    load_ledger,
    register_views,
    save_buckets,
    save_ledger,
    unsalted,
)

__all__ = [
    "Ledger",
    "Statements",
    "accounting_equation",
    "bs_by_account",
    "bs_yoy",
    "change_rollup",
    "financial_statements",
    "from_files",
    "from_parquet",
    "from_tables",
    "ledger",
    "line_count",
    "load_buckets",
    "load_ledger",
    "load_rollup",
    "load_sorted",
    "master_classified",
    "master_lines",
    "pl_by_year",
    "pl_one_year",
    "pl_yoy",
    "refresh_rollup",
    "register_functions",
    "register_views",
    "rollup",
    "save_buckets",
    "save_ledger",
    "save_rollup",
    "save_sorted",
    "section_crosstab",
    "section_names",
    "section_totals",
    "sorted_files",
    "statement_rows",
    "unsalted",
]
