"""Money measures as column functions.

All of them are linear in the amounts, so each may be applied to single postings
or to sums of postings (see operators.amounts) with the same total.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from finstat.schema import ASSET_SECTIONS, EQUITY_SECTIONS, LIABILITY_SECTIONS


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def money(column: Column) -> Column:
    """An exact amount as reported: two decimals, double."""
    return F.round(column, 2).cast("double")


def gross(debit: Column, credit: Column) -> Column:
    return or_zero(credit) + or_zero(debit)


def net(debit: Column, credit: Column) -> Column:
    return or_zero(credit) - or_zero(debit)


def by_sign(gross_amount: Column, net_amount: Column, flag: Column, netting: bool = False) -> Column:
    """Pick the P&L amount by the section's sign flag; NULL for any other flag.

    A debit-positive section adds both sides, so a refund on an expense *raises*
    it. ``netting`` nets it instead (debit minus credit).
    """
    debit_positive = -net_amount if netting else gross_amount
    return F.when(flag == 1, debit_positive).when(flag == 0, net_amount)


def pl_amount(debit: Column, credit: Column, flag: Column, netting: bool = False) -> Column:
    return by_sign(gross(debit, credit), net(debit, credit), flag, netting)


def lone_debit(debit: Column, credit: Column) -> Column:
    """The debit of a posting whose credit side is empty, else 0."""
    return F.when(credit.isNull(), or_zero(debit)).otherwise(0)


def lone_credit(debit: Column, credit: Column) -> Column:
    """The credit of a posting whose debit side is empty, else 0."""
    return F.when(debit.isNull(), or_zero(credit)).otherwise(0)


# The side measures take the key of a section name (predicates.name_key), lone debits and lone
# credits: a posting with both sides filled counts to no side of the balance sheet.


def asset_amount(key: Column, debit: Column, credit: Column) -> Column:
    return F.when(key.isin(*ASSET_SECTIONS), debit - credit).otherwise(0)


def liability_amount(key: Column, debit: Column, credit: Column) -> Column:
    return F.when(key.isin(*LIABILITY_SECTIONS), credit - debit).otherwise(0)


def equity_amount(key: Column, debit: Column, credit: Column) -> Column:
    return F.when(key.isin(*EQUITY_SECTIONS), credit - debit).otherwise(0)


def bs_amount(key: Column, debit: Column, credit: Column, asset_credits: bool = False) -> Column:
    """One amount per balance-sheet section, whatever its side.

    The two-year balance sheet leaves credits on assets out (unlike
    ``asset_amount``); ``asset_credits`` subtracts them.
    """
    asset = debit - credit if asset_credits else debit
    return (
        F.when(key.isin(*ASSET_SECTIONS), asset)
        .when(key.isin(*LIABILITY_SECTIONS, *EQUITY_SECTIONS), credit - debit)
        .otherwise(0)
    )


def yoy_pct(current: Column, previous: Column, base: str = "current") -> Column:
    """% change between two amounts as reported; NULL when either is NULL or the base is 0.

    The default base is the *current* year; ``base='previous'`` is the textbook form.
    Both operands of the division are whole cents, so it is the only inexact step
    and a quotient that ends in a 5 rounds away from zero, as an exact one would. Amounts of more than
    thirty digits, whose cents do not fit a decimal, are divided as doubles.
    """
    bases = {"current": current, "previous": previous}
    if base not in bases:
        raise ValueError(f"unknown base {base!r}")
    now, then, below = (F.round(c, 2) for c in (current, previous, bases[base]))
    exact = F.try_multiply(F.try_subtract(now, then), F.lit(10_000)).cast("double")
    change = F.coalesce(exact, (now.cast("double") - then.cast("double")) * 10_000)
    cents = F.coalesce(F.try_multiply(below, F.lit(100)).cast("double"), below.cast("double") * 100)
    return F.round(change / F.nullif(cents, F.lit(0.0)), 2)
