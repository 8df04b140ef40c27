"""The same results in SQL, straight from the lines: no rollup, no per-account totals.

Each query is a body over common table expressions; ``sql`` prepends the ones needed.
"""

from __future__ import annotations

from finstat.schema import ASSET_SECTIONS, EQUITY_SECTIONS, LIABILITY_SECTIONS
from finstat.sources.tpch import NO_ACCOUNT, NO_ENTRY, section_values


def _names(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{name}'" for name in names) + ")"


ASSETS, LIABILITIES, EQUITY = _names(ASSET_SECTIONS), _names(LIABILITY_SECTIONS), _names(EQUITY_SECTIONS)

PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
CHARGED = (
    "CAST(CAST(l_extendedprice AS DECIMAL(11,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) "
    "* (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,6))"
)

# Sums of more digits than a bigint or a double tells apart: the cents stay at the end of thirty digits.
WIDE = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST('10000000000000000000001' AS DECIMAL(23,0)) AS DECIMAL(38,2))"

# name -> (needed CTEs, definition); FIXTURES.md section 2 gives the first four.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "sections": (
        (),
        f"""SELECT CAST(id AS INTEGER) AS statement_section_id, name AS statement_section,
            CAST(flag AS INTEGER) AS debit_is_positive, CAST(sheet AS INTEGER) AS is_balance_sheet_section
        FROM (VALUES {section_values()}) AS s(id, name, flag, sheet)
        WHERE id IN (SELECT p_partkey % 16 FROM part)""",
    ),
    "accounts": (
        (),
        """SELECT p_partkey AS account_id, p_name AS account, p_brand AS account_code,
            CAST(p_size % 2 AS INTEGER) AS postable,
            CAST(CASE WHEN p_partkey % 16 BETWEEN 6 AND 12 THEN p_partkey % 16
                 WHEN p_partkey % 16 = 14 THEN 6 WHEN p_partkey % 16 = 15 THEN NULL
                 ELSE 0 END AS INTEGER) AS profit_loss_section_id,
            CAST(CASE WHEN p_partkey % 16 BETWEEN 1 AND 5 THEN p_partkey % 16
                 WHEN p_partkey % 16 = 13 THEN 2 WHEN p_partkey % 16 = 14 THEN 4
                 WHEN p_partkey % 16 = 15 THEN 99 ELSE 0 END AS INTEGER) AS balance_sheet_section_id
        FROM part""",
    ),
    "entries": (
        (),
        """SELECT o_orderkey AS journal_entry_id, o_orderpriority AS journal_entry,
            'JE-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS journal_entry_code,
            CAST(o_orderdate AS DATE) AS entry_date,
            CASE WHEN o_orderkey % 20 = 0 THEN 0 ELSE 1 END AS debit_credit_balanced,
            CASE WHEN o_custkey % 50 = 1 THEN NULL ELSE o_custkey % 50 END AS user_id,
            CASE o_orderkey % 25 WHEN 7 THEN 1 WHEN 8 THEN NULL ELSE 0 END AS cancelled,
            CASE WHEN month(o_orderdate) = 12 AND o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS closing_type
        FROM orders""",
    ),
    "priced": (
        (),
        f"""SELECT *, {PRICE} AS price, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
            CASE WHEN l_returnflag = 'A' THEN 'debit'
                 WHEN l_returnflag = 'N' THEN 'credit'
                 WHEN l_linenumber = 6 THEN 'both'
                 WHEN l_linenumber = 7 THEN 'neither'
                 WHEN l_linestatus = 'F' THEN 'debit' ELSE 'credit' END AS side
        FROM lineitem""",
    ),
    "lines": (
        ("priced",),
        f"""SELECT CASE WHEN l_orderkey % {NO_ENTRY} = 13 THEN -l_orderkey ELSE l_orderkey END AS journal_entry_id,
            CASE WHEN l_partkey % {NO_ACCOUNT} = 7 THEN -l_partkey ELSE l_partkey END AS account_id,
            l_linenumber AS line_item,
            l_returnflag || l_linestatus AS description,
            CASE WHEN side IN ('debit', 'both') THEN price END AS debit,
            CASE side WHEN 'credit' THEN price WHEN 'both' THEN quantity END AS credit
        FROM priced""",
    ),
    # An account with its sections in both roles, and its one aligned name.
    "chart": (
        ("accounts", "sections"),
        """SELECT a.*, pl.statement_section_id AS pl_section_id, pl.statement_section AS pl_section,
            pl.debit_is_positive, bs.statement_section_id AS bs_section_id,
            bs.statement_section AS bs_section, bs.is_balance_sheet_section,
            upper(rtrim(pl.statement_section)) AS pl_key, upper(rtrim(bs.statement_section)) AS bs_key,
            CASE WHEN pl_key <> '' THEN pl.statement_section ELSE bs.statement_section END AS name,
            CASE WHEN pl_key <> '' THEN pl_key ELSE bs_key END AS name_key,
            CASE WHEN pl_key <> '' THEN pl_section_id ELSE bs_section_id END AS name_id
        FROM accounts a
        LEFT JOIN sections pl ON pl.statement_section_id = a.profit_loss_section_id
        LEFT JOIN sections bs ON bs.statement_section_id = a.balance_sheet_section_id""",
    ),
    # Every line with everything known about it.
    "book": (
        ("lines", "entries", "chart"),
        """SELECT l.journal_entry_id, l.line_item, l.account_id, l.debit, l.credit, c.* EXCLUDE (account_id),
            e.journal_entry, e.journal_entry_code, e.entry_date, CAST(year(e.entry_date) AS INTEGER) AS entry_year,
            debit_credit_balanced = 1 AND user_id <> 0 AND closing_type = 0 AS kept,
            cancelled = 0 AS live
        FROM lines l
        LEFT JOIN entries e ON e.journal_entry_id = l.journal_entry_id
        LEFT JOIN chart c ON c.account_id = l.account_id""",
    ),
    # Lines that count, with the P&L amount and the three balance-sheet sides.
    "posted": (
        ("book",),
        f"""SELECT *,
            CASE debit_is_positive WHEN 1 THEN coalesce(debit, 0) + coalesce(credit, 0)
                 WHEN 0 THEN coalesce(credit, 0) - coalesce(debit, 0) END AS pl_amount,
            CASE WHEN debit IS NOT NULL AND credit IS NOT NULL THEN 0
                 ELSE coalesce(debit, 0) - coalesce(credit, 0) END AS balance,
            CASE WHEN name_key IN {ASSETS} THEN balance ELSE 0 END AS asset,
            CASE WHEN name_key IN {LIABILITIES} THEN -balance ELSE 0 END AS liability,
            CASE WHEN name_key IN {EQUITY} THEN -balance ELSE 0 END AS owned,
            CASE WHEN name_key IN {ASSETS} THEN CASE WHEN credit IS NULL THEN balance ELSE 0 END
                 ELSE liability + owned END AS sheet_amount
        FROM book WHERE kept AND live""",
    ),
}


def sql(body: str, *needs: str) -> str:
    """The body under a WITH clause of the needed expressions, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][0]:
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name][1]})" for name in ordered) + "\n" + body


def double(expression: str, alias: str) -> str:
    return f"CAST({expression} AS DOUBLE) AS {alias}"


def rounded(expression: str, alias: str) -> str:
    """An amount as reported: rounded after the sum."""
    return double(f"round({expression}, 2)", alias)


def priced(text: str, prices: str) -> str:
    """The same query over amounts made in another way (tpch.PRICES)."""
    return text.replace(PRICE, {"cents": PRICE, "subcent": CHARGED, "wide": WIDE}[prices])


def exact(text: str) -> str:
    """The same query with names that match and group as they are spelled."""
    return text.replace("upper(rtrim(pl.statement_section))", "pl.statement_section").replace(
        "upper(rtrim(bs.statement_section))", "bs.statement_section"
    )


def cents(expression: str) -> str:
    return f"CAST(CAST(round({expression}, 2) AS DECIMAL(20,2)) * 100 AS HUGEINT)"


def percent(current: str, previous: str) -> str:
    """% change on the current amount in whole numbers: exact, and halves go away from zero."""
    change, base = f"({cents(current)} - {cents(previous)})", cents(current)
    hundredths = f"((abs({change}) * 20000 + abs({base})) // (2 * nullif(abs({base}), 0)))"
    return f"CAST({hundredths} * sign({change}) * sign({base}) AS DOUBLE) / 100"


TWO_YEARS = ", ".join(
    [rounded("q", "query_year"), rounded("p", "previous_year"), f"{percent('q', 'p')} AS yoy_growth_pct"]
)


# --- reports ----------------------------------------------------------------


def line_count(fy: int) -> str:
    return sql(f"SELECT count(*) AS n FROM book WHERE entry_year = {fy}", "book")


def section_totals(fy: int) -> str:
    return sql(
        f"""SELECT arg_min(pl_section, pl_section_id) AS statement_section, debit_is_positive, count(*) AS n_lines,
            {rounded("sum(debit)", "debit")}, {rounded("sum(credit)", "credit")}
        FROM book WHERE kept AND entry_year = {fy} AND pl_section_id <> 0 GROUP BY pl_key, debit_is_positive""",
        "book",
    )


def pl_by_year() -> str:
    return sql(
        f"""SELECT arg_min(pl_section, pl_section_id) AS statement_section, entry_year, {rounded("sum(pl_amount)", "amount")}
        FROM posted WHERE pl_key <> '' GROUP BY pl_key, entry_year""",
        "posted",
    )


def pl_one_year(fy: int) -> str:
    return sql(
        f"""SELECT arg_min(pl_section, pl_section_id) AS statement_section, {rounded("sum(pl_amount)", "amount")}
        FROM posted WHERE entry_year = {fy} AND pl_section_id <> 0
        GROUP BY pl_key, pl_section_id ORDER BY pl_section_id""",
        "posted",
    )


def pl_yoy(fy: int, section: str = "pl_section_id <> 0") -> str:
    return sql(
        f"""SELECT statement_section, {TWO_YEARS}
        FROM (SELECT pl_section_id, arg_min(pl_section, pl_section_id) AS statement_section,
                sum(pl_amount) FILTER (WHERE entry_year = {fy}) AS q,
                sum(pl_amount) FILTER (WHERE entry_year = {fy - 1}) AS p
              FROM posted WHERE {section} GROUP BY pl_key, pl_section_id) t
        ORDER BY pl_section_id""",
        "posted",
    )


def section_crosstab(fy: int) -> str:
    return sql(
        f"""SELECT arg_min(pl_section, pl_section_id) AS pl_section, arg_min(bs_section, bs_section_id) AS bs_section, count(*) AS n_lines FROM posted
        WHERE entry_year = {fy} AND (pl_section_id <> 0 OR bs_section_id <> 0) GROUP BY pl_key, bs_key""",
        "posted",
    )


def master_lines(fy: int) -> str:
    return sql(
        f"""SELECT name AS statement_section, account, account_id, account_code, line_item, postable,
            journal_entry, journal_entry_code, bs_section_id AS statement_section_id, is_balance_sheet_section,
            {double("debit", "debit")}, {double("credit", "credit")}
        FROM posted WHERE entry_year = {fy} AND (pl_section_id <> 0 OR bs_section_id <> 0)""",
        "posted",
    )


def section_names() -> str:
    return sql(
        """SELECT arg_min(statement_section, statement_section_id) AS statement_section FROM sections
        GROUP BY upper(rtrim(statement_section))""",
        "sections",
    )


def master_classified(fy: int) -> str:
    return sql(
        f"""SELECT postable, name, account, journal_entry_code, journal_entry, line_item,
            {rounded("asset", "assets")}, {rounded("liability", "liabilities")}, {rounded("owned", "equity")}
        FROM posted WHERE entry_year = {fy} AND (pl_section_id <> 0 OR bs_section_id <> 0)
        ORDER BY is_balance_sheet_section DESC NULLS LAST, bs_section_id NULLS FIRST,
            journal_entry_code NULLS FIRST""",
        "posted",
    )


SIDE_SUMS = ", ".join(
    rounded(f"sum({column})", alias)
    for column, alias in (("asset", "assets"), ("liability", "liabilities"), ("owned", "equity"))
)


def bs_by_account(fy: int) -> str:
    return sql(
        f"""SELECT account_code, arg_min(name, name_id) AS name, {SIDE_SUMS} FROM posted
        WHERE entry_year = {fy} AND is_balance_sheet_section = 1 GROUP BY account_code, name_key""",
        "posted",
    )


def accounting_equation(fy: int) -> str:
    return sql(
        f"""SELECT assets, '=' AS eq, liabilities, '+' AS plus, equity
        FROM (SELECT {SIDE_SUMS} FROM posted WHERE entry_year = {fy}) t""",
        "posted",
    )


def bs_yoy(fy: int) -> str:
    return sql(
        f"""SELECT name, {TWO_YEARS}
        FROM (SELECT name_key, arg_min(name, name_id) AS name,
                sum(CASE WHEN entry_year = {fy} THEN sheet_amount ELSE 0 END) AS q,
                sum(CASE WHEN entry_year = {fy - 1} THEN sheet_amount ELSE 0 END) AS p
              FROM posted WHERE is_balance_sheet_section = 1 GROUP BY name_key) t
        ORDER BY name_key NULLS FIRST""",
        "posted",
    )


def financial_statements(fy: int) -> str:
    """The three statements under one heading each, as rows of one table."""
    return f"""SELECT 'profit and loss' AS statement, statement_section AS item,
            query_year, previous_year, yoy_growth_pct FROM ({pl_yoy(fy, "pl_key <> ''")}) pl
        UNION ALL
        SELECT 'balance sheet', name, query_year, previous_year, yoy_growth_pct FROM ({bs_yoy(fy)}) bs
        UNION ALL
        SELECT 'equation', side, amount, NULL, NULL
        FROM ({accounting_equation(fy)}) e,
            LATERAL (VALUES ('assets', assets), ('liabilities', liabilities), ('equity', equity)) AS v(side, amount)"""


def rollup() -> str:
    sides = ("debit", "credit", "lone_debit", "lone_credit")
    return sql(
        f"""SELECT account_id, entry_year AS fiscal_year, count(*) AS n_lines,
            {", ".join(rounded(f"sum({side})", side) for side in sides)}
        FROM (SELECT account_id, entry_year, debit, credit,
                CASE WHEN credit IS NULL THEN coalesce(debit, 0) ELSE 0 END AS lone_debit,
                CASE WHEN debit IS NULL THEN coalesce(credit, 0) ELSE 0 END AS lone_credit
              FROM posted) t
        GROUP BY 1, 2""",
        "posted",
    )
