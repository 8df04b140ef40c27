"""The reports. Each returns a lazy DataFrame; the caller shows or writes it.

``amounts`` takes a stored rollup (plans.rollup) in place of the ledger's lines;
the result is the same. Reports without that argument need rows a rollup lacks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstat.functions.measures import (
    asset_amount,
    bs_amount,
    by_sign,
    equity_amount,
    liability_amount,
    lone_credit,
    lone_debit,
    money,
    pl_amount,
    yoy_pct,
)
from finstat.functions.predicates import fiscal_year, has_any_section, has_section, in_year, name_key, on_balance_sheet
from finstat.operators.amounts import (
    KEYS,
    added,
    amounts_of,
    as_amounts,
    lone_measures,
    per_account,
    pl_measures,
    plain,
    total,
    two_years,
    with_posted,
)
from finstat.operators.joins import (
    lines_of,
    master,
    posted_lines,
    with_accounts,
    with_both_sections,
    with_entries,
    with_pl_section,
)
from finstat.schema import MAX_DIGITS
from finstat.sources.ledger import Ledger


def with_spelling(groups: DataFrame, book: Ledger, number: str, alias: str) -> DataFrame:
    """Show a group's name as its section with the smallest id spells it.

    The groups carry that id, not the name: a minimum of numbers keeps the aggregate a hash aggregate.
    """
    names = book.sections.select(F.col("statement_section_id").alias(number), F.col("statement_section").alias(alias))
    return groups.join(names, number, "left")


def _with_pl(totals: DataFrame, book: Ledger) -> DataFrame:
    return with_pl_section(with_accounts(totals, book), book)


# --- checks on the ledger ---------------------------------------------------


def line_count(book: Ledger, fy: int) -> DataFrame:
    """Number of ledger lines in a year, whatever the status of their entries."""
    rows = as_amounts(with_entries(lines_of(book, fy), book).filter(in_year("entry_date", fy)))
    # Counted per account first; the dimension joins would still multiply the
    # count if an account or section key were not unique.
    joined = _with_pl(per_account(rows, plain("n_lines")), book)
    return joined.agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n"))


def section_totals(book: Ledger, fy: int) -> DataFrame:
    """Lines, debits and credits per P&L section in a year. Cancelled entries stay in."""
    rows = as_amounts(posted_lines(book, fy, check_cancelled=False))
    totals = per_account(rows, plain("n_lines", "debit", "credit"))
    sums = (
        _with_pl(totals, book)
        .filter(has_section())
        .groupBy("pl_key", "debit_is_positive")
        .agg(
            F.min("pl_section_id").alias("number"),
            total("n_lines"),
            money(added("debit")).alias("debit"),
            money(added("credit")).alias("credit"),
        )
    )
    named = with_spelling(sums, book, "number", "statement_section")
    return named.select("statement_section", "debit_is_positive", "n_lines", "debit", "credit")


def section_crosstab(book: Ledger, fy: int, amounts: DataFrame | None = None) -> DataFrame:
    """Lines per (P&L section, B/S section) in a year, for accounts with either."""
    totals = per_account(amounts_of(book, fy, amounts), plain("n_lines"))
    rows = with_both_sections(totals, book).filter(has_any_section())
    numbers = [F.min(f"{role}_section_id").alias(role) for role in ("pl", "bs")]
    counts = rows.groupBy("pl_key", "bs_key").agg(*numbers, total("n_lines"))
    named = with_spelling(with_spelling(counts, book, "pl", "pl_section"), book, "bs", "bs_section")
    return named.select("pl_section", "bs_section", "n_lines")


def section_names(book: Ledger) -> DataFrame:
    """Distinct section names, the empty sentinel included."""
    key = name_key(F.col("statement_section"), book.exact_names).alias("key")
    numbers = book.sections.groupBy(key).agg(F.min("statement_section_id").alias("number"))
    return with_spelling(numbers, book, "number", "statement_section").select("statement_section")


# --- profit and loss --------------------------------------------------------


def pl_by_year(book: Ledger, netting: bool = False, amounts: DataFrame | None = None) -> DataFrame:
    """P&L amount per section and year, for all years."""
    totals = per_account(amounts_of(book, None, amounts), pl_measures(), keys=("account_id", "fiscal_year"))
    sums = (
        _with_pl(totals, book)
        .filter(has_section("name"))
        .groupBy("pl_key", F.col("fiscal_year").alias("entry_year"))
        .agg(F.min("pl_section_id").alias("number"), money(added(_signed(netting=netting))).alias("amount"))
    )
    named = with_spelling(sums, book, "number", "statement_section")
    return named.select("statement_section", "entry_year", "amount")


def pl_one_year(book: Ledger, fy: int, netting: bool = False, amounts: DataFrame | None = None) -> DataFrame:
    """P&L amount per section for a year, in statement order."""
    totals = per_account(amounts_of(book, fy, amounts), pl_measures())
    per_section = (
        _with_pl(totals, book)
        .filter(has_section())
        .groupBy("pl_key", "pl_section_id")
        .agg(money(added(_signed(netting=netting))).alias("amount"))
    )
    named = with_spelling(per_section, book, "pl_section_id", "statement_section")
    return named.orderBy("pl_section_id").select("statement_section", "amount")


def pl_yoy(
    book: Ledger,
    fy: int,
    section_filter: str = "id",
    base: str = "current",
    netting: bool = False,
    amounts: DataFrame | None = None,
) -> DataFrame:
    """P&L per section: a year, the year before, and the % change, in statement order.

    A section with lines in any year is listed, so lines of all years are read, unless the
    ledger knows its posted accounts; a year without lines gives NULL.
    """
    fy = fiscal_year(fy)
    measures = pl_measures(fy, "query_") | pl_measures(fy - 1, "previous_")
    rows, posted = two_years(book, fy, amounts)
    totals = with_posted(per_account(rows, measures), posted)
    per_section = (
        _with_pl(totals, book)
        .filter(has_section(section_filter))
        .groupBy("pl_key", "pl_section_id")
        .agg(
            added(_signed("query_", netting)).alias("query"),
            added(_signed("previous_", netting)).alias("previous"),
        )
    )
    named = with_spelling(per_section, book, "pl_section_id", "statement_section")
    return named.orderBy("pl_section_id").select("statement_section", *_two_years(base))


def _signed(prefix: str = "", netting: bool = False) -> Column:
    return by_sign(F.col(prefix + "gross"), F.col(prefix + "net"), F.col("debit_is_positive"), netting)


def _two_years(base: str) -> list[Column]:
    query, previous = F.col("query"), F.col("previous")
    return [
        money(query).alias("query_year"),
        money(previous).alias("previous_year"),
        yoy_pct(query, previous, base).alias("yoy_growth_pct"),
    ]


# --- balance sheet ----------------------------------------------------------


def master_lines(book: Ledger, fy: int) -> DataFrame:
    """Posted lines of a year with their account, entry and aligned section name."""
    return (
        master(book, fy)
        .filter(has_any_section())
        .select(
            F.col("name").alias("statement_section"),
            "account",
            "account_id",
            "account_code",
            "line_item",
            "postable",
            "journal_entry",
            "journal_entry_code",
            F.col("bs_section_id").alias("statement_section_id"),
            "is_balance_sheet_section",
            F.col("debit").cast("double").alias("debit"),
            F.col("credit").cast("double").alias("credit"),
        )
    )


def master_classified(book: Ledger, fy: int) -> DataFrame:
    """Posted lines of a year as assets, liabilities and equity, balance-sheet lines first.

    Lines that tie on the report's three sort keys are ordered by line and
    account. The order is then fixed, and the range partitions of the sort can
    cut through an entry that holds a large share of the lines.
    """
    debit, credit = F.col("debit"), F.col("credit")
    return (
        master(book, fy)
        .filter(has_any_section())
        .withColumn("lone_debit", lone_debit(debit, credit))
        .withColumn("lone_credit", lone_credit(debit, credit))
        .orderBy(
            F.desc("is_balance_sheet_section"),
            F.asc("bs_section_id"),
            F.asc("journal_entry_code"),
            F.asc("line_item"),
            F.asc("account_id"),
        )
        .select(
            "postable",
            "name",
            "account",
            "journal_entry_code",
            "journal_entry",
            "line_item",
            *[money(side).alias(label) for label, side in _sides().items()],
        )
    )


def bs_by_account(book: Ledger, fy: int, amounts: DataFrame | None = None) -> DataFrame:
    """Assets, liabilities and equity of a year per account code and section name."""
    totals = per_account(amounts_of(book, fy, amounts), lone_measures())
    sums = (
        with_both_sections(totals, book)
        .filter(on_balance_sheet())
        .groupBy("account_code", "name_key")
        .agg(F.min("name_id").alias("number"), *_side_sums())
    )
    named = with_spelling(sums, book, "number", "name")
    return named.select("account_code", "name", "assets", "liabilities", "equity")


def accounting_equation(book: Ledger, fy: int, amounts: DataFrame | None = None) -> DataFrame:
    """Assets = liabilities + equity of a year, in one row. P&L accounts count to equity."""
    totals = per_account(amounts_of(book, fy, amounts), lone_measures())
    sums = with_both_sections(totals, book).agg(*_side_sums())
    return sums.select("assets", F.lit("=").alias("eq"), "liabilities", F.lit("+").alias("plus"), "equity")


def bs_yoy(
    book: Ledger,
    fy: int,
    base: str = "current",
    asset_credits: bool = False,
    amounts: DataFrame | None = None,
) -> DataFrame:
    """Balance sheet per section name: a year, the year before, and the % change, by name.

    A name with lines in any year is listed; a year without lines gives 0.
    """
    fy = fiscal_year(fy)
    measures = lone_measures(fy, "query_") | lone_measures(fy - 1, "previous_")
    rows, posted = two_years(book, fy, amounts)
    totals = with_posted(per_account(rows, measures), posted, dict.fromkeys(measures, F.lit(0)))

    def amount(prefix: str) -> Column:
        debit, credit = F.col(prefix + "lone_debit"), F.col(prefix + "lone_credit")
        return added(bs_amount(F.col("name_key"), debit, credit, asset_credits))

    per_name = (
        with_both_sections(totals, book)
        .filter(on_balance_sheet())
        .groupBy("name_key")
        .agg(F.min("name_id").alias("number"), amount("query_").alias("query"), amount("previous_").alias("previous"))
    )
    return with_spelling(per_name, book, "number", "name").orderBy("name_key").select("name", *_two_years(base))


def _sides() -> dict[str, Column]:
    columns = (F.col("name_key"), F.col("lone_debit"), F.col("lone_credit"))
    return {
        "assets": asset_amount(*columns),
        "liabilities": liability_amount(*columns),
        "equity": equity_amount(*columns),
    }


def _side_sums() -> list[Column]:
    return [money(added(side)).alias(label) for label, side in _sides().items()]


# --- all statements of a year -----------------------------------------------


PROFIT_LOSS, BALANCE_SHEET, EQUATION = "profit and loss", "balance sheet", "equation"


@dataclass(frozen=True)
class Statements:
    """The statements of a year: each as a frame of its own, and all of them as the rows of one.

    A frame is planned when it is asked for. ``rows`` passes over the lines once; the others do so one by one.
    """

    book: Ledger
    fy: int
    amounts: DataFrame | None = None
    section_filter: str = "nonblank"
    base: str = "current"
    netting: bool = False
    asset_credits: bool = False

    @cached_property
    def profit_loss(self) -> DataFrame:
        return pl_yoy(self.book, self.fy, self.section_filter, self.base, self.netting, self.amounts)

    @cached_property
    def balance_sheet(self) -> DataFrame:
        return bs_yoy(self.book, self.fy, self.base, self.asset_credits, self.amounts)

    @cached_property
    def equation(self) -> DataFrame:
        return accounting_equation(self.book, self.fy, self.amounts)

    @cached_property
    def rows(self) -> DataFrame:
        return statement_rows(self.book, self.fy, self.amounts, self.section_filter, self.base, self.netting, self.asset_credits)


def statement_rows(
    book: Ledger,
    fy: int | str,
    amounts: DataFrame | None = None,
    section_filter: str = "nonblank",
    base: str = "current",
    netting: bool = False,
    asset_credits: bool = False,
) -> DataFrame:
    """P&L with change, balance sheet with change, and the accounting equation, from one pass over the lines.

    Rows: statement, item, query_year, previous_year, yoy_growth_pct, in the order of the statements. The
    equation's items are assets, liabilities and equity, with an amount each.

    The lines are totalled once per account and year; each total then makes a row for every statement
    that it counts to, and all statements are one aggregate of those.
    """
    fy = fiscal_year(fy)
    rows, posted = two_years(book, fy, amounts)
    # All years but the two are one, without amounts that count: it tells that an account has lines.
    rows = rows.withColumn("fiscal_year", F.when(F.col("fiscal_year").between(fy - 1, fy), F.col("fiscal_year")))
    totals = with_posted(per_account(rows, plain("debit", "credit", "lone_debit", "lone_credit"), KEYS), posted)
    scale = totals.schema["debit"].dataType.scale
    measured = with_both_sections(totals, book).select(
        F.col("fiscal_year").alias("year"),
        "pl_key",
        "pl_section_id",
        "name_key",
        "name_id",
        has_section(section_filter).alias("in_result"),
        on_balance_sheet().alias("on_sheet"),
        pl_amount(F.col("debit"), F.col("credit"), F.col("debit_is_positive"), netting).alias("result"),
        bs_amount(F.col("name_key"), F.col("lone_debit"), F.col("lone_credit"), asset_credits).alias("sheet"),
        *[amount.alias(side) for side, amount in _sides().items()],
    )
    kind = f"DECIMAL({MAX_DIGITS + 1},{scale})"

    def row(keep: str, statement: int, key: str, place: str, number: str, this: str, last: str) -> str:
        figures = f"CAST({this} AS {kind}) AS this, CAST({last} AS {kind}) AS last"
        return f"struct({keep} AS keep, {statement} AS statement, {key} AS key, {place} AS place, CAST({number} AS INT) AS number, {figures})"

    counted = [
        row("in_result", 0, "pl_key", "pl_section_id", "pl_section_id", *(f"CASE WHEN year = {y} THEN result END" for y in (fy, fy - 1))),
        row("on_sheet", 1, "name_key", "0", "name_id", *(f"CASE WHEN year = {y} THEN sheet ELSE 0 END" for y in (fy, fy - 1))),
        *[row(f"year = {fy}", 2, f"'{side}'", str(n), "NULL", side, "NULL") for n, side in enumerate(_sides())],
    ]
    found = measured.selectExpr(f"inline(array({', '.join(counted)}))").filter("keep").drop("keep")
    # The equation has its items in a year without lines, too.
    items = ", ".join(f"(2, '{side}', {n})" for n, side in enumerate(_sides()))
    listed = book.sections.sparkSession.sql(f"SELECT * FROM VALUES {items} AS t(statement, key, place)")
    sums = (
        found.unionByName(listed, allowMissingColumns=True)
        .groupBy("statement", "key", "place")
        .agg(F.min("number").alias("number"), added("this").alias("query"), added("last").alias("previous"))
    )
    named = with_spelling(sums, book, "number", "spelling")
    change = [c if n == 0 else F.when(F.col("statement") < 2, c) for n, c in enumerate(_two_years(base))]
    return named.orderBy("statement", "place", "key").select(
        F.element_at(F.array(*map(F.lit, (PROFIT_LOSS, BALANCE_SHEET, EQUATION))), F.col("statement") + 1).alias("statement"),
        F.when(F.col("statement") < 2, F.col("spelling")).otherwise(F.col("key")).alias("item"),
        *[c.alias(name) for c, name in zip(change, ("query_year", "previous_year", "yoy_growth_pct"), strict=True)],
    )


def financial_statements(
    book: Ledger,
    fy: int | str,
    amounts: DataFrame | None = None,
    section_filter: str = "nonblank",
    base: str = "current",
    netting: bool = False,
    asset_credits: bool = False,
) -> Statements:
    """P&L with change, balance sheet with change, and the accounting equation of a year.

    Building them runs nothing and writes nothing. ``rows`` has all of them from one pass over the lines. The frames
    of their own pass over the lines one by one when they are run, unless ``amounts``
    gives a rollup stored before (``save_rollup``, ``load_rollup``): then no one does.
    """
    return Statements(book, fiscal_year(fy), amounts, section_filter, base, netting, asset_credits)
