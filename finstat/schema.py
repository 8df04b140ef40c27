"""Logical ledger schema and the section vocabulary of the measures."""

from __future__ import annotations

from pyspark.sql import types as T

# Money is held exactly, at the scale it comes with: sums then do not depend on row order or
# partitioning, and are rounded once, when they are reported.
MONEY = T.DecimalType(18, 2)
# What amounts that are no decimals are held as: exact to a millionth, below 10**12.
FLOAT_MONEY = T.DecimalType(18, 6)
# The most digits of an amount or a total, and the most decimals. Two digits of a decimal stay free, so
# that the sum or difference of two of them always fits.
MAX_DIGITS, MAX_SCALE = 36, 8


def money_sum(scale: int) -> T.DecimalType:
    """The type of totals of amounts of a scale."""
    return T.DecimalType(MAX_DIGITS, scale)


LINES = T.StructType(
    [
        T.StructField("journal_entry_id", T.LongType()),
        T.StructField("account_id", T.LongType()),
        T.StructField("line_item", T.IntegerType()),
        T.StructField("description", T.StringType()),
        # A NULL side is data: it tells debit postings from credit postings.
        T.StructField("debit", MONEY),
        T.StructField("credit", MONEY),
    ]
)

ENTRIES = T.StructType(
    [
        T.StructField("journal_entry_id", T.LongType()),
        T.StructField("journal_entry", T.StringType()),
        T.StructField("journal_entry_code", T.StringType()),
        T.StructField("entry_date", T.DateType()),
        T.StructField("debit_credit_balanced", T.IntegerType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("cancelled", T.IntegerType()),
        T.StructField("closing_type", T.IntegerType()),
    ]
)

ACCOUNTS = T.StructType(
    [
        T.StructField("account_id", T.LongType()),
        T.StructField("account", T.StringType()),
        T.StructField("account_code", T.StringType()),
        T.StructField("postable", T.IntegerType()),
        T.StructField("profit_loss_section_id", T.IntegerType()),
        T.StructField("balance_sheet_section_id", T.IntegerType()),
    ]
)

SECTIONS = T.StructType(
    [
        T.StructField("statement_section_id", T.IntegerType()),
        T.StructField("statement_section", T.StringType()),
        T.StructField("debit_is_positive", T.IntegerType()),
        T.StructField("is_balance_sheet_section", T.IntegerType()),
    ]
)


def rollup(scale: int) -> T.StructType:
    """One row per (account, year); also the shape of a single posting (see operators.amounts)."""
    money = money_sum(scale)
    counts = ("n_lines", "n_debit", "n_credit")
    sums = ("debit", "credit", "lone_debit", "lone_credit")
    return T.StructType(
        [
            T.StructField("account_id", T.LongType()),
            *[T.StructField(name, T.LongType()) for name in counts],
            *[T.StructField(name, money) for name in sums],
            T.StructField("fiscal_year", T.IntegerType()),
        ]
    )


# Which side of A = L + E a section name counts to.
# A name in none of the three counts to no side.
ASSET_SECTIONS = ("CURRENT ASSETS", "FIXED ASSETS")
LIABILITY_SECTIONS = ("CURRENT LIABILITIES",)
EQUITY_SECTIONS = (
    "REVENUE",
    "OTHER INCOME",
    "COST OF GOODS AND SERVICES",
    "OTHER EXPENSES",
    "SELLING EXPENSES",
    "INCOME TAX",
    "EQUITY",
)
