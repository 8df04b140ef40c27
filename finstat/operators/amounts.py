"""Postings as additive amounts, and their totals per account.

An *amounts* frame has the columns
``account_id, fiscal_year, n_lines, debit, credit, lone_debit, lone_credit``
and comes in two forms: one row per posting with money in whole units of its scale
(bigint; cents for two decimals), or rows with money as decimal, such as the stored
account-year rollup. Amounts too long for a bigint are decimals in single postings, too. Every measure is linear in them, so a statement is one
formula for both. A sum that does not fit raises, in ANSI mode or not.

Statements first total the amounts per account and join the dimensions to those
totals. That keeps the fact out of every join but the one with its header: a hot
account shrinks to one row per map task before it is shuffled, and the accounts
may outgrow a broadcast without the fact being shuffled again.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finstat.functions.measures import gross, lone_credit, lone_debit, net
from finstat.functions.predicates import fiscal_year
from finstat.operators.joins import posted_lines
from finstat.schema import money_sum
from finstat.sources.ledger import Ledger, exact_money, money_type

KEYS = ("account_id", "fiscal_year")
COUNTS = ("n_lines", "n_debit", "n_credit")
SUMS = (*COUNTS, "debit", "credit", "lone_debit", "lone_credit")

_LOW_BITS = 20
_BIGINT_DIGITS = 18  # that always fit a bigint


def units(money: Column, scale: int) -> Column:
    return (money * F.lit(Decimal(10**scale))).cast("long")


def as_amounts(rows: DataFrame, year_column: str | None = None) -> DataFrame:
    """Lines joined to their entries, as an amounts frame of single postings.

    ``year_column`` has the year of the entry where it is stored on the lines; filters on the year then prune folders.
    """
    kind = money_type(*(rows.schema[side].dataType for side in ("debit", "credit")))
    debit, credit = (exact_money(rows, side, kind) for side in ("debit", "credit"))
    if kind.precision <= _BIGINT_DIGITS:
        debit, credit = units(debit, kind.scale), units(credit, kind.scale)
    return rows.select(
        "account_id",
        (F.col(year_column).cast("int") if year_column else F.year("entry_date")).alias("fiscal_year"),
        F.lit(1).cast("long").alias("n_lines"),
        *[F.when(side.isNotNull(), 1).otherwise(0).cast("long").alias(name) for name, side in (("n_debit", debit), ("n_credit", credit))],
        debit.alias("debit", metadata={"scale": kind.scale}),
        credit.alias("credit"),
        lone_debit(debit, credit).alias("lone_debit"),
        lone_credit(debit, credit).alias("lone_credit"),
    )


def amounts_of(
    book: Ledger,
    fy: int | None = None,
    amounts: DataFrame | None = None,
) -> DataFrame:
    """The amounts of one year or of all, from a stored rollup if one is given."""
    if amounts is None:
        return as_amounts(posted_lines(book, fy), book.year_column)
    return amounts if fy is None else amounts.filter(F.col("fiscal_year") == fiscal_year(fy))


def sum_units(units: str, scale: int) -> Column:
    """The exact sum of whole units (a bigint, as SQL text), as decimal money.

    Summing the high and the low bits as two bigints is several times cheaper
    than a decimal sum, whose buffer does not fit a machine word. The low parts
    cannot overflow below 2**43 rows per group; high parts that do, beyond a total of 9e24 units, raise.
    """
    low = f"sum({units} & {(1 << _LOW_BITS) - 1})"
    high = fitting(f"try_sum(shiftright({units}, {_LOW_BITS}))", f"{low} IS NOT NULL")
    whole = f"CAST(CAST({high} AS DECIMAL(19,0)) * {1 << _LOW_BITS}BD + CAST({low} AS DECIMAL(19,0)) AS DECIMAL(28,0))"
    return F.expr(f"CAST({whole} * {Decimal(1).scaleb(-scale):f}BD AS {money_sum(scale).simpleString()})")


def sum_money(amount: str, scale: int) -> Column:
    """The exact sum of decimal money (as SQL text)."""
    # Partial sums have two digits more than totals. A decimal sum that overflows gives NULL, or raises in ANSI mode.
    total = fitting(f"sum({amount})", f"count({amount}) > 0")
    return F.expr(fitting(f"try_cast({total} AS {money_sum(scale).simpleString()})", f"count({amount}) > 0"))


def fitting(value: str, given: str) -> str:
    """The sum, which is NULL where nothing was summed; NULL in spite of ``given`` rows, it did not fit and raises."""
    return f"CASE WHEN {given} AND {value} IS NULL THEN raise_error('a total of amounts does not fit') ELSE {value} END"


def two_years(book: Ledger, fy: int, amounts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The amounts that a report of a year and the year before needs, and the accounts that have lines in any year.

    Where the accounts are known (``posted_accounts`` of a stored ledger), lines of two years are read. Else the
    amounts are those of all years, and tell by themselves.
    """
    if amounts is not None or book.posted_accounts is None:
        return amounts_of(book, None, amounts), None
    return as_amounts(posted_lines(book, fy, before=1), book.year_column), book.posted_accounts


def with_posted(totals: DataFrame, posted: DataFrame | None, otherwise: dict[str, Column] | None = None) -> DataFrame:
    """The totals, and a row without amounts for each account that has lines in any year."""
    if posted is None:
        return totals
    empty = [
        (otherwise or {}).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in totals.schema if f.name != "account_id"
    ]
    return totals.unionByName(posted.select("account_id", *empty))


def per_account(amounts: DataFrame, measures: dict[str, Column], keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """The measures summed per account: counts as bigint, money as decimal."""
    debit = amounts.schema["debit"]
    sums = []
    for name in measures:
        if name in COUNTS:
            summed = F.sum(name)
        elif debit.dataType == T.LongType():
            summed = sum_units(name, debit.metadata["scale"])
        else:
            summed = sum_money(name, debit.dataType.scale)
        sums.append(summed.alias(name))
    # Named below the aggregate, so that a sum can be put down as one piece of SQL.
    return amounts.select(*keys, *[column.alias(name) for name, column in measures.items()]).groupBy(*keys).agg(*sums)


def added(column: Column | str) -> Column:
    """The sum of totals; one that does not fit raises."""
    summed = F.sum(column)
    short = (F.count(column) > 0) & summed.isNull()
    return F.when(short, F.raise_error(F.lit("a total of amounts does not fit"))).otherwise(summed)


def plain(*names: str) -> dict[str, Column]:
    return {name: F.col(name) for name in names}


def total(column: str) -> Column:
    return F.sum(column).alias(column)


def pl_measures(year: int | None = None, prefix: str = "") -> dict[str, Column]:
    """Gross and net, optionally of one year only; NULL for a posting that does not qualify."""
    debit, credit = F.col("debit"), F.col("credit")
    return {
        prefix + "gross": _in(year, gross(debit, credit)),
        prefix + "net": _in(year, net(debit, credit)),
    }


def lone_measures(year: int | None = None, prefix: str = "") -> dict[str, Column]:
    """The lone sides, optionally of one year only; 0 for a posting that does not qualify."""
    return {prefix + name: _in(year, F.col(name), F.lit(0)) for name in ("lone_debit", "lone_credit")}


def _in(year: int | None, column: Column, otherwise: Column | None = None) -> Column:
    if year is None:
        return column
    picked = F.when(F.col("fiscal_year") == year, column)
    return picked if otherwise is None else picked.otherwise(otherwise)
