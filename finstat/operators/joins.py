"""The ledger joins: fact to header, fact to chart of accounts, account to its sections.

All are left joins on one key, as the semantics ask. Where a later filter rejects
the NULLs of an unmatched row, Catalyst turns them into inner joins by itself.
Spark broadcasts a side only while its size is under
``spark.sql.autoBroadcastJoinThreshold`` and sort-merges it beyond; there is no hint.

Section names carry a key beside their spelling (``name_key``): names match and group by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstat.functions.predicates import fiscal_year, in_year, name_key, posted
from finstat.sources.ledger import Ledger


def with_entries(lines: DataFrame, book: Ledger) -> DataFrame:
    salt = [book.salt_column] if book.salt_column else []
    return lines.join(book.entries, ["journal_entry_id", *salt], "left")


def with_accounts(frame: DataFrame, book: Ledger) -> DataFrame:
    return frame.join(book.accounts, "account_id", "left")


def section_role(book: Ledger, role: str) -> DataFrame:
    """The section table under the column names of one of its two roles."""
    name = F.col("statement_section")
    return book.sections.select(
        F.col("statement_section_id").alias(f"{role}_section_id"),
        name.alias(f"{role}_section"),
        name_key(name, book.exact_names).alias(f"{role}_key"),
        "debit_is_positive" if role == "pl" else "is_balance_sheet_section",
    )


def with_pl_section(frame: DataFrame, book: Ledger) -> DataFrame:
    pl = section_role(book, "pl")
    return frame.join(pl, F.col("profit_loss_section_id") == F.col("pl_section_id"), "left")


def with_bs_section(frame: DataFrame, book: Ledger) -> DataFrame:
    bs = section_role(book, "bs")
    return frame.join(bs, F.col("balance_sheet_section_id") == F.col("bs_section_id"), "left")


def _aligned(column: str) -> Column:
    return F.when(F.col("pl_key") != "", F.col(f"pl_{column}")).otherwise(F.col(f"bs_{column}"))


def with_aligned_name(frame: DataFrame) -> DataFrame:
    """One section name per account: the P&L one unless it is blank or unknown."""
    return frame.withColumns({"name": _aligned("section"), "name_key": _aligned("key"), "name_id": _aligned("section_id")})


def with_both_sections(frame: DataFrame, book: Ledger) -> DataFrame:
    """Both section roles and the aligned ``name``; for any frame with an ``account_id``."""
    return with_aligned_name(with_bs_section(with_pl_section(with_accounts(frame, book), book), book))


def chart(book: Ledger) -> DataFrame:
    """Accounts with both section roles and the aligned ``name``."""
    return with_aligned_name(with_bs_section(with_pl_section(book.accounts, book), book))


def lines_of(book: Ledger, fy: int | None, before: int = 0) -> DataFrame:
    """The lines that can belong to a year, or to so many before it: a stored layout prunes the others, else all of them."""
    if fy is None or book.year_column is None:
        return book.lines
    last = fiscal_year(fy)
    return book.lines.filter(F.col(book.year_column).between(last - before, last) if before else F.col(book.year_column) == last)


def posted_lines(
    book: Ledger,
    fy: int | None = None,
    check_cancelled: bool = True,
    before: int = 0,
) -> DataFrame:
    """Lines of entries that count, of one year (and so many before it) or of all."""
    rows = with_entries(lines_of(book, fy, before), book).filter(posted(check_cancelled))
    return rows if fy is None else rows.filter(in_year("entry_date", fy, before))


def master(book: Ledger, fy: int | None = None) -> DataFrame:
    """The line-level master table: posted lines with account, both sections and name."""
    return with_both_sections(posted_lines(book, fy), book)
