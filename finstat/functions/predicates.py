"""Row filters. A NULL operand makes a comparison NULL, and a filter drops the row."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_year(value: int | str) -> int:
    """The year parameter as an int; text such as ``'2016'`` is accepted."""
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise TypeError(f"fiscal year must be an int or its text, not {value!r}")
    return int(value)


def in_year(column: str, fy: int | str, before: int = 0) -> Column:
    """``year(column)`` is fy, or one of so many years before it, written as a half-open range so that it prunes files.

    Spark pushes a range on the bare column into the scan; ``year(column)`` it does not.
    """
    fy = fiscal_year(fy)
    if not 1 <= fy - before <= fy < datetime.MAXYEAR:
        return F.year(column).between(fy - before, fy)
    return (F.col(column) >= F.lit(datetime.date(fy - before, 1, 1))) & (F.col(column) < F.lit(datetime.date(fy + 1, 1, 1)))


def posted(check_cancelled: bool = True) -> Column:
    """Entries that count: balanced, entered by a person, not a closing entry, not cancelled."""
    live = (F.col("debit_credit_balanced") == 1) & (F.col("user_id") != 0) & (F.col("closing_type") == 0)
    return live & (F.col("cancelled") == 0) if check_cancelled else live


def name_key(name: Column, exact: bool = False) -> Column:
    """What section names match and group by: the one rule for all of them.

    Case and trailing blanks make no difference, unless names are exact.
    """
    return name if exact else F.upper(F.rtrim(name))


def has_section(section_filter: str = "id", role: str = "pl") -> Column:
    """Whether an account has a section in a role.

    ``id``: the section id is not the sentinel 0. ``name``: the name is not empty.
    ``nonblank``: the name is not blank; this differs from ``name`` only where names are exact.
    """
    key = F.col(f"{role}_key")
    if section_filter == "id":
        return F.col(f"{role}_section_id") != 0
    if section_filter == "name":
        return key != ""
    if section_filter == "nonblank":
        return F.rtrim(key) != ""
    raise ValueError(f"unknown section filter {section_filter!r}")


def has_any_section() -> Column:
    """A section in either role; one known section outweighs an unknown one."""
    return has_section(role="bs") | has_section(role="pl")


def on_balance_sheet() -> Column:
    return F.col("is_balance_sheet_section") == 1
