"""The statements as SQL table functions of the fiscal year: ``SELECT * FROM financial_statements(fy => 2016)``.

The functions are temporary ones of the session, over temporary views. Spark puts the year into their bodies when a
query is planned, so filters on it reach the files as they do from Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstat.functions.measures import asset_amount, bs_amount, equity_amount, liability_amount, pl_amount
from finstat.functions.predicates import on_balance_sheet
from finstat.operators.amounts import KEYS, amounts_of, per_account, plain
from finstat.operators.joins import with_both_sections
from finstat.sources.ledger import Ledger, register_views

ACCOUNT_YEAR, POSTED = "ledger_account_year", "ledger_posted_account"
FIGURES = "query_year DOUBLE, previous_year DOUBLE, yoy_growth_pct DOUBLE"


def register_functions(book: Ledger, amounts: DataFrame | None = None) -> None:
    """Register the ledger's views and the functions over them.

    - ``pl_yoy(fy)``, ``bs_yoy(fy)``, ``accounting_equation(fy)``: the reports of these names, with their defaults.
    - ``financial_statements(fy)``: all statements as rows, from one pass over the lines.

    Amounts are summed as decimals of eight places and up to thirty digits before them; run them in ANSI mode, which raises beyond.

    ``amounts`` gives a stored rollup in place of the lines. Functions and views registered before are replaced.
    """
    spark = book.sections.sparkSession
    register_views(book)
    totals = per_account(amounts_of(book, None, amounts), plain("debit", "credit", "lone_debit", "lone_credit"), KEYS)
    measured(totals, book).createOrReplaceTempView(ACCOUNT_YEAR)
    source = ACCOUNT_YEAR
    if amounts is None and book.posted_accounts is not None:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in totals.schema if f.name != "account_id"]
        measured(book.posted_accounts.select("account_id", *empty), book).createOrReplaceTempView(POSTED)
        source = f"(SELECT * FROM {ACCOUNT_YEAR} WHERE fiscal_year BETWEEN fy - 1 AND fy UNION ALL SELECT * FROM {POSTED})"
    result, sheet, sides = _result("pl_section_id <> 0"), _sheet(), _equation()
    both = "statement_section AS name, query_year, previous_year, yoy_growth_pct"
    bodies = {
        f"pl_yoy(fy INT) RETURNS TABLE(statement_section STRING, {FIGURES})": f"SELECT {both} {_rows(source, [result])}",
        f"bs_yoy(fy INT) RETURNS TABLE(name STRING, {FIGURES})": f"SELECT {both} {_rows(source, [sheet])}",
        "accounting_equation(fy INT) RETURNS TABLE(assets DOUBLE, eq STRING, liabilities DOUBLE, plus STRING, equity DOUBLE)": (
            "SELECT CAST(round(sum(assets), 2) AS DOUBLE), '=', CAST(round(sum(liabilities), 2) AS DOUBLE), '+', "
            f"CAST(round(sum(equity), 2) AS DOUBLE) FROM {ACCOUNT_YEAR} WHERE fiscal_year = fy"
        ),
        f"financial_statements(fy INT) RETURNS TABLE(statement STRING, item STRING, {FIGURES})": (
            "SELECT element_at(array('profit and loss', 'balance sheet', 'equation'), statement + 1), "
            "CASE WHEN statement < 2 THEN statement_section ELSE key END, query_year, "
            "CASE WHEN statement < 2 THEN previous_year END, CASE WHEN statement < 2 THEN yoy_growth_pct END "
            + _rows(source, [_result("trim(pl_key) <> ''"), sheet, *sides])
        ),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def _rows(source: str, counted: list[str]) -> str:
    """FROM clause: a row per item of the statements that the structs count to, with its figures, in statement order."""
    items = "SELECT 2 AS statement, side AS key, n AS place, CAST(NULL AS INT) AS number, NULL AS this, NULL AS last "
    items += "FROM VALUES ('assets', 0), ('liabilities', 1), ('equity', 2) AS v(side, n)"
    found = f"SELECT statement, key, place, number, this, last FROM (SELECT inline(array({', '.join(counted)})) FROM {source}) WHERE keep"
    # The equation has its items in a year without lines, too.
    found = f"{found} UNION ALL {items}" if len(counted) > 1 else found
    sums = f"SELECT statement, key, place, min(number) AS number, sum(this) AS query, sum(last) AS previous FROM ({found}) GROUP BY statement, key, place"
    cents = "CAST(round(query, 2) * 100 AS DOUBLE)"
    pct = f"round(CAST((round(query, 2) - round(previous, 2)) * 10000 AS DOUBLE) / nullif({cents}, 0), 2)"
    return (
        "FROM (SELECT t.*, s.statement_section, CAST(round(query, 2) AS DOUBLE) AS query_year, "
        f"CAST(round(previous, 2) AS DOUBLE) AS previous_year, {pct} AS yoy_growth_pct "
        f"FROM ({sums}) t LEFT JOIN statement_section s ON s.statement_section_id = t.number) ORDER BY statement, place, key"
    )


def _counted(keep: str, statement: int, key: str, place: str, number: str, this: str, last: str) -> str:
    figures = f"CAST({this} AS DECIMAL(38,8)) AS this, CAST({last} AS DECIMAL(38,8)) AS last"
    return f"struct({keep} AS keep, {statement} AS statement, {key} AS key, {place} AS place, CAST({number} AS INT) AS number, {figures})"


def _result(keep: str) -> str:
    years = (f"CASE WHEN fiscal_year = {year} THEN result END" for year in ("fy", "fy - 1"))
    return _counted(keep, 0, "pl_key", "pl_section_id", "pl_section_id", *years)


def _sheet() -> str:
    years = (f"CASE WHEN fiscal_year = {year} THEN sheet ELSE 0 END" for year in ("fy", "fy - 1"))
    return _counted("on_sheet", 1, "name_key", "0", "name_id", *years)


def _equation() -> list[str]:
    sides = ("assets", "liabilities", "equity")
    return [_counted("fiscal_year = fy", 2, f"'{side}'", str(n), "NULL", side, "NULL") for n, side in enumerate(sides)]


def measured(totals: DataFrame, book: Ledger) -> DataFrame:
    """Totals per account and year with what each counts to in the statements."""
    key, debit, credit = F.col("name_key"), F.col("lone_debit"), F.col("lone_credit")
    return with_both_sections(totals, book).select(
        "fiscal_year",
        "pl_key",
        "pl_section_id",
        "name_key",
        "name_id",
        on_balance_sheet().alias("on_sheet"),
        pl_amount(F.col("debit"), F.col("credit"), F.col("debit_is_positive")).alias("result"),
        bs_amount(key, debit, credit).alias("sheet"),
        asset_amount(key, debit, credit).alias("assets"),
        liability_amount(key, debit, credit).alias("liabilities"),
        equity_amount(key, debit, credit).alias("equity"),
    )
