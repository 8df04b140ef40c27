"""The registered queries and their SQL twins, one pair per key."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstat.functions import measures as M
from finstat.functions import predicates as P
from finstat.operators import amounts as A
from finstat.operators import joins as J
from finstat.plans import statements as S
from finstat.plans.ordered import load_sorted, save_sorted
from finstat.plans.rollup import rollup
from finstat.registry import oracle
from finstat.registry.oracle import double, sql
from finstat.schema import ASSET_SECTIONS, EQUITY_SECTIONS, LIABILITY_SECTIONS
from finstat.session import staging_path
from finstat.sources import tpch
from finstat.sources.buckets import load_buckets, save_buckets
from finstat.sources.ledger import Ledger

Query = Callable[[SparkSession, str], DataFrame]

# A year with a full previous year, one without a previous year,
# and one without lines of its own (FIXTURES.md section 2).
YEAR, FIRST_YEAR, EMPTY_YEAR = 2000, 1995, 2002

# On a loaded ledger, and from (session, folder) as the driver calls them.
REPORTS: dict[str, Callable[[Ledger], DataFrame]] = {}
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle_text: str, prices: str = "cents", exact_names: bool = False):
    """Register a function of a ledger under a key, with its SQL twin.

    ``prices``: how the ledger's amounts are made (tpch.PRICES). ``exact_names``: names go by their spelling.
    """

    def wrap(function: Callable[[Ledger], DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(tpch.load_ledger(spark, sf_dir, prices, exact_names))

        REPORTS[key] = function
        QUERIES[key] = query
        text = oracle.priced(oracle_text, prices)
        ORACLES[key] = oracle.exact(text) if exact_names else text
        return function

    return wrap


def _c(*names: str):
    return tuple(F.col(name) for name in names)


# --- reports ----------------------------------------------------------------

for _fy, _suffix in ((YEAR, ""), (FIRST_YEAR, "_1995"), (EMPTY_YEAR, "_2002")):
    register("r01_line_count" + _suffix, oracle.line_count(_fy))(lambda b, fy=_fy: S.line_count(b, fy))
    register("r04_pl_one_year" + _suffix, oracle.pl_one_year(_fy))(lambda b, fy=_fy: S.pl_one_year(b, fy))
    register("r05_pl_yoy" + _suffix, oracle.pl_yoy(_fy))(lambda b, fy=_fy: S.pl_yoy(b, fy))
    register("r11_equation" + _suffix, oracle.accounting_equation(_fy))(
        lambda b, fy=_fy: S.accounting_equation(b, fy)
    )
    register("r12_bs_yoy" + _suffix, oracle.bs_yoy(_fy))(lambda b, fy=_fy: S.bs_yoy(b, fy))

register("r02_section_totals", oracle.section_totals(YEAR))(lambda b: S.section_totals(b, YEAR))
register("r03_pl_by_year", oracle.pl_by_year())(lambda b: S.pl_by_year(b))
register("r06_section_crosstab", oracle.section_crosstab(YEAR))(lambda b: S.section_crosstab(b, YEAR))
register("r07_master_lines", oracle.master_lines(YEAR))(lambda b: S.master_lines(b, YEAR))
register("r08_distinct_sections", oracle.section_names())(S.section_names)
register("r09_master_classified", oracle.master_classified(YEAR))(lambda b: S.master_classified(b, YEAR))
register("r05_pl_yoy_subcent", oracle.pl_yoy(YEAR), prices="subcent")(lambda b: S.pl_yoy(b, YEAR))
register("r11_equation_subcent", oracle.accounting_equation(YEAR), prices="subcent")(
    lambda b: S.accounting_equation(b, YEAR)
)
register("r11_equation_wide", oracle.accounting_equation(YEAR), prices="wide")(lambda b: S.accounting_equation(b, YEAR))
register("r10_bs_by_account", oracle.bs_by_account(YEAR))(lambda b: S.bs_by_account(b, YEAR))

# --- the statements by parameter --------------------------------------------

_NONBLANK = "pl_key <> ''"

for _fy, _suffix in ((YEAR, ""), (FIRST_YEAR, "_1995")):
    register("p1_pl_yoy_param" + _suffix, oracle.pl_yoy(_fy, _NONBLANK))(
        lambda b, fy=_fy: S.pl_yoy(b, fy, section_filter="nonblank")
    )
    register("p2_bs_yoy_param" + _suffix, oracle.bs_yoy(_fy))(lambda b, fy=_fy: S.bs_yoy(b, str(fy)))
    register("p3_equation_param" + _suffix, oracle.accounting_equation(_fy))(
        lambda b, fy=_fy: S.accounting_equation(b, str(fy))
    )


@register("p_financial_statements", oracle.financial_statements(YEAR))
def statements_as_rows(book: Ledger, amounts: DataFrame | None = None) -> DataFrame:
    """All three statements, as rows of one table."""
    return S.financial_statements(book, YEAR, amounts).rows


for _fy, _suffix in ((FIRST_YEAR, "_1995"), (EMPTY_YEAR, "_2002")):
    register("p_financial_statements" + _suffix, oracle.financial_statements(_fy))(
        lambda b, fy=_fy: S.statement_rows(b, str(fy))
    )


@register("rollup_account_year", oracle.rollup())
def rollup_rows(book: Ledger) -> DataFrame:
    sides = ("debit", "credit", "lone_debit", "lone_credit")
    return rollup(book).select("account_id", "fiscal_year", "n_lines", *[M.money(F.col(s)).alias(s) for s in sides])


# --- scans and derived table ------------------------------------------------


@register(
    "op_scan_lines",
    sql(
        f"""SELECT journal_entry_id, account_id, line_item, description,
            {double("debit", "debit")}, {double("credit", "credit")} FROM lines""",
        "lines",
    ),
)
def scan_lines(book: Ledger) -> DataFrame:
    money = [F.col(side).cast("double").alias(side) for side in ("debit", "credit")]
    return book.lines.select("journal_entry_id", "account_id", "line_item", "description", *money)


register("op_scan_entries", sql("SELECT * FROM entries", "entries"))(lambda b: b.entries)
register("op_scan_accounts", sql("SELECT * FROM accounts", "accounts"))(lambda b: b.accounts)
register("op_scan_sections", sql("SELECT * FROM sections", "sections"))(lambda b: b.sections)


@register("op_derived_table", sql("SELECT name, entry_date, count(*) AS n FROM posted GROUP BY 1, 2", "posted"))
def derived_table(book: Ledger) -> DataFrame:
    # Counted per account first: no single line is shuffled to the accounts.
    counts = J.posted_lines(book).groupBy("account_id", "entry_date").agg(F.count(F.lit(1)).alias("n"))
    return J.with_both_sections(counts, book).groupBy("name", "entry_date").agg(A.total("n"))


# --- projections ------------------------------------------------------------


@register(
    "op_project_alias",
    f"""SELECT statement_section AS "Section", query_year AS "Query Year", previous_year AS "Previous Year",
        yoy_growth_pct AS "YoY Growth(%)" FROM ({oracle.pl_yoy(YEAR)}) t""",
)
def project_alias(book: Ledger) -> DataFrame:
    return S.pl_yoy(book, YEAR).select(
        F.col("statement_section").alias("Section"),
        F.col("query_year").alias("Query Year"),
        F.col("previous_year").alias("Previous Year"),
        F.col("yoy_growth_pct").alias("YoY Growth(%)"),
    )


@register(
    "op_literal_columns",
    sql(
        f"""SELECT account_code, '=' AS eq, {double("sum(debit)", "debit")}, '+' AS plus,
            {double("sum(credit)", "credit")}, 100 AS percent, '' AS empty, ' ' AS blank
        FROM book GROUP BY account_code""",
        "book",
    ),
)
def literal_columns(book: Ledger) -> DataFrame:
    totals = book.lines.groupBy("account_id").agg(A.total("debit"), A.total("credit"))
    sums = J.with_accounts(totals, book).groupBy("account_code").agg(A.total("debit"), A.total("credit"))
    return sums.select(
        "account_code",
        F.lit("=").alias("eq"),
        M.money(F.col("debit")).alias("debit"),
        F.lit("+").alias("plus"),
        M.money(F.col("credit")).alias("credit"),
        F.lit(100).alias("percent"),
        F.lit("").alias("empty"),
        F.lit(" ").alias("blank"),
    )


@register("op_section_name", sql("SELECT account_id, pl_section, bs_section, name FROM chart", "chart"))
def section_name(book: Ledger) -> DataFrame:
    return J.chart(book).select("account_id", "pl_section", "bs_section", "name")


# --- filters ----------------------------------------------------------------

_IN_YEAR = sql(f"SELECT journal_entry_id, entry_date FROM entries WHERE year(entry_date) = {YEAR}", "entries")


def _entries_of(book: Ledger, fy: int | str) -> DataFrame:
    return book.entries.filter(P.in_year("entry_date", fy)).select("journal_entry_id", "entry_date")


register("op_filter_year_int", _IN_YEAR)(lambda b: _entries_of(b, YEAR))
register("op_filter_year_string", _IN_YEAR)(lambda b: _entries_of(b, str(YEAR)))


@register(
    "op_filter_flags",
    sql(
        """SELECT journal_entry_id, user_id, cancelled FROM entries
        WHERE debit_credit_balanced = 1 AND user_id <> 0 AND closing_type = 0 AND cancelled = 0""",
        "entries",
    ),
)
def filter_flags(book: Ledger) -> DataFrame:
    return book.entries.filter(P.posted()).select("journal_entry_id", "user_id", "cancelled")


def _accounts_with(book: Ledger, section_filter: str) -> DataFrame:
    chart = J.with_pl_section(book.accounts, book)
    return chart.filter(P.has_section(section_filter)).select("account_id", "pl_section_id", "pl_section")


_SECTION_COLUMNS = "SELECT account_id, pl_section_id, pl_section FROM chart WHERE "
register("op_filter_section_id", sql(_SECTION_COLUMNS + "pl_section_id <> 0", "chart"))(
    lambda b: _accounts_with(b, "id")
)
register("op_filter_nonblank", sql(_SECTION_COLUMNS + "pl_key <> ''", "chart"))(
    lambda b: _accounts_with(b, "name")
)
register("op_filter_nonblank_padded", sql(_SECTION_COLUMNS + "pl_key <> ''", "chart"))(
    lambda b: _accounts_with(b, "nonblank")
)
# With exact names the two differ: a name of blanks alone is not empty, but blank.
register("op_filter_nonblank_exact", sql(_SECTION_COLUMNS + "pl_section <> ''", "chart"), exact_names=True)(
    lambda b: _accounts_with(b, "name")
)
register("op_filter_nonblank_padded_exact", sql(_SECTION_COLUMNS + "trim(pl_section) <> ''", "chart"), exact_names=True)(
    lambda b: _accounts_with(b, "nonblank")
)
register("r08_distinct_sections_exact", sql("SELECT DISTINCT statement_section FROM sections", "sections"), exact_names=True)(S.section_names)


@register(
    "op_filter_or",
    sql(
        """SELECT account_id, pl_section_id, bs_section_id FROM chart
        WHERE bs_section_id <> 0 OR pl_section_id <> 0""",
        "chart",
    ),
)
def filter_or(book: Ledger) -> DataFrame:
    return J.chart(book).filter(P.has_any_section()).select("account_id", "pl_section_id", "bs_section_id")


@register(
    "op_outer_filter",
    sql(
        """SELECT name, is_balance_sheet_section, count(*) AS n FROM posted
        WHERE is_balance_sheet_section = 1 GROUP BY 1, 2""",
        "posted",
    ),
)
def outer_filter(book: Ledger) -> DataFrame:
    counts = A.per_account(A.amounts_of(book), A.plain("n_lines"))
    rows = J.with_both_sections(counts, book).filter(P.on_balance_sheet())
    return rows.groupBy("name", "is_balance_sheet_section").agg(F.sum("n_lines").alias("n"))


@register(
    "op_filter_in",
    sql(
        f"""SELECT name, name_key IN {oracle.ASSETS} AS is_asset, name_key IN {oracle.LIABILITIES} AS is_liability,
            name_key IN {oracle.EQUITY} AS is_equity, count(*) AS n
        FROM book WHERE name_key IN {oracle.ASSETS} OR name_key IN {oracle.LIABILITIES} OR name_key IN {oracle.EQUITY}
        GROUP BY 1, 2, 3, 4""",
        "book",
    ),
)
def filter_in(book: Ledger) -> DataFrame:
    (key,) = _c("name_key")
    kinds = {"is_asset": ASSET_SECTIONS, "is_liability": LIABILITY_SECTIONS, "is_equity": EQUITY_SECTIONS}
    counts = book.lines.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    rows = J.with_both_sections(counts, book).filter(key.isin(*ASSET_SECTIONS, *LIABILITY_SECTIONS, *EQUITY_SECTIONS))
    return rows.groupBy("name", *[key.isin(*names).alias(k) for k, names in kinds.items()]).agg(A.total("n"))


@register(
    "op_filter_null",
    sql(
        """SELECT journal_entry_id, account_id, line_item, credit IS NULL AS no_credit, debit IS NULL AS no_debit
        FROM lines WHERE credit IS NULL OR debit IS NULL""",
        "lines",
    ),
)
def filter_null(book: Ledger) -> DataFrame:
    debit, credit = _c("debit", "credit")
    return book.lines.filter(credit.isNull() | debit.isNull()).select(
        "journal_entry_id",
        "account_id",
        "line_item",
        credit.isNull().alias("no_credit"),
        debit.isNull().alias("no_debit"),
    )


@register(
    "op_pivot_years",
    sql(
        f"""SELECT account_id,
            {double(f"sum(coalesce(credit, 0) - coalesce(debit, 0)) FILTER (WHERE entry_year = {YEAR})", "query_net")},
            {double(f"sum(coalesce(credit, 0) - coalesce(debit, 0)) FILTER (WHERE entry_year = {YEAR - 1})", "previous_net")}
        FROM posted GROUP BY account_id""",
        "posted",
    ),
)
def pivot_years(book: Ledger) -> DataFrame:
    totals = A.per_account(A.amounts_of(book), A.pl_measures(YEAR, "query_") | A.pl_measures(YEAR - 1, "previous_"))
    return totals.select("account_id", *[M.money(F.col(c)).alias(c) for c in ("query_net", "previous_net")])


# --- joins ------------------------------------------------------------------


@register(
    "op_left_join_entries",
    sql(
        """SELECT l.journal_entry_id, l.line_item, l.account_id, e.entry_date, e.journal_entry_code
        FROM lines l LEFT JOIN entries e ON e.journal_entry_id = l.journal_entry_id""",
        "lines",
        "entries",
    ),
)
def left_join_entries(book: Ledger) -> DataFrame:
    return J.with_entries(book.lines, book).select(
        "journal_entry_id", "line_item", "account_id", "entry_date", "journal_entry_code"
    )


@register(
    "op_left_join_buckets",
    sql(
        """SELECT l.journal_entry_id, l.line_item, l.account_id, e.entry_date, e.journal_entry_code
        FROM lines l LEFT JOIN entries e ON e.journal_entry_id = l.journal_entry_id""",
        "lines",
        "entries",
    ),
)
def left_join_buckets(book: Ledger) -> DataFrame:
    """The same join of tables that are bucketed and salted, so that no line is shuffled for it."""
    spark = book.lines.sparkSession
    path = staging_path(spark, "buckets")
    database = path.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    save_buckets(book, database, buckets=16)
    return left_join_entries(load_buckets(spark, database))


@register(
    "op_left_join_accounts",
    sql(
        """SELECT l.journal_entry_id, l.line_item, l.account_id, a.account_code, a.postable
        FROM lines l LEFT JOIN accounts a ON a.account_id = l.account_id""",
        "lines",
        "accounts",
    ),
)
def left_join_accounts(book: Ledger) -> DataFrame:
    return J.with_accounts(book.lines, book).select(
        "journal_entry_id", "line_item", "account_id", "account_code", "postable"
    )


@register("op_left_join_pl", sql("SELECT account_id, pl_section, debit_is_positive FROM chart", "chart"))
def left_join_pl(book: Ledger) -> DataFrame:
    return J.with_pl_section(book.accounts, book).select("account_id", "pl_section", "debit_is_positive")


@register(
    "op_join_role_playing",
    sql("SELECT account_id, pl_section_id, pl_section, bs_section_id, bs_section FROM chart", "chart"),
)
def join_role_playing(book: Ledger) -> DataFrame:
    return J.chart(book).select("account_id", "pl_section_id", "pl_section", "bs_section_id", "bs_section")


@register(
    "op_join_null_rejecting",
    sql("SELECT journal_entry_id, line_item, pl_section FROM posted WHERE pl_section_id <> 0", "posted"),
)
def join_null_rejecting(book: Ledger) -> DataFrame:
    rows = J.with_pl_section(J.with_accounts(J.posted_lines(book), book), book)
    return rows.filter(P.has_section()).select("journal_entry_id", "line_item", "pl_section")


# --- aggregations -----------------------------------------------------------

@register("op_count_star", sql("SELECT count(*) AS n FROM book", "book"))
def count_star(book: Ledger) -> DataFrame:
    return J.with_entries(book.lines, book).agg(F.count(F.lit(1)).alias("n"))


@register("op_count_grouped", sql("SELECT entry_date, count(*) AS n FROM book GROUP BY 1", "book"))
def count_grouped(book: Ledger) -> DataFrame:
    return J.with_entries(book.lines, book).groupBy("entry_date").agg(F.count(F.lit(1)).alias("n"))


def _money_sum(amount: str):
    """A sum of amounts with two decimals, as reported."""
    return M.money(A.sum_units(f"CAST({amount} * 100 AS BIGINT)", 2))


@register(
    "op_sum",
    sql(
        f"""SELECT journal_entry_id, {double("sum(debit)", "debit")}, {double("sum(credit)", "credit")}
        FROM lines GROUP BY 1""",
        "lines",
    ),
)
def sum_column(book: Ledger) -> DataFrame:
    sums = [_money_sum(side).alias(side) for side in ("debit", "credit")]
    return book.lines.groupBy("journal_entry_id").agg(*sums)


@register(
    "op_sum_case_null",
    sql(f"""SELECT account_id, {double("sum(CASE WHEN debit > credit THEN debit END)", "amount")}
        FROM lines GROUP BY 1""", "lines"),
)
def sum_case_null(book: Ledger) -> DataFrame:
    return book.lines.groupBy("account_id").agg(_money_sum("CASE WHEN debit > credit THEN debit END").alias("amount"))


@register(
    "op_sum_case_zero",
    sql(f"""SELECT account_id, {double("sum(CASE WHEN debit > credit THEN debit ELSE 0 END)", "amount")}
        FROM lines GROUP BY 1""", "lines"),
)
def sum_case_zero(book: Ledger) -> DataFrame:
    picked = "CASE WHEN debit > credit THEN debit ELSE 0 END"
    return book.lines.groupBy("account_id").agg(_money_sum(picked).alias("amount"))


@register(
    "op_ratio",
    sql(
        f"""SELECT account_code, {oracle.percent("credit", "debit")} AS margin_pct
        FROM (SELECT account_code, sum(debit) AS debit, sum(credit) AS credit FROM book GROUP BY 1) t""",
        "book",
    ),
)
def ratio(book: Ledger) -> DataFrame:
    totals = book.lines.groupBy("account_id").agg(A.total("debit"), A.total("credit"))
    sums = J.with_accounts(totals, book).groupBy("account_code").agg(A.total("debit"), A.total("credit"))
    return sums.select("account_code", M.yoy_pct(*_c("credit", "debit")).alias("margin_pct"))


@register(
    "op_round_sum",
    sql(f"SELECT entry_year, {double('round(sum(debit), 2)', 'debit')} FROM book GROUP BY 1", "book"),
    prices="subcent",
)
def round_sum(book: Ledger) -> DataFrame:
    rows = A.as_amounts(J.with_entries(book.lines, book))
    return A.per_account(rows, A.plain("debit"), keys=("fiscal_year",)).select(
        F.col("fiscal_year").alias("entry_year"), M.money(F.col("debit")).alias("debit")
    )


@register(
    "op_group_alias",
    sql("SELECT CAST(year(entry_date) AS INTEGER) AS entry_year, count(*) AS n FROM entries GROUP BY entry_year", "entries"),
)
def group_alias(book: Ledger) -> DataFrame:
    return book.entries.groupBy(F.year("entry_date").alias("entry_year")).agg(F.count(F.lit(1)).alias("n"))


@register("op_group_computed", sql("SELECT name, count(*) AS n FROM chart GROUP BY 1", "chart"))
def group_computed(book: Ledger) -> DataFrame:
    return J.chart(book).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@register(
    "op_group_hidden_key",
    sql("SELECT pl_section, count(*) AS n FROM chart GROUP BY pl_section, pl_section_id, postable", "chart"),
)
def group_hidden_key(book: Ledger) -> DataFrame:
    groups = J.with_pl_section(book.accounts, book).groupBy("pl_section", "pl_section_id", "postable")
    return groups.agg(F.count(F.lit(1)).alias("n")).select("pl_section", "n")


@register("op_group_null_key", sql("SELECT pl_section, bs_section, count(*) AS n FROM book GROUP BY 1, 2", "book"))
def group_null_key(book: Ledger) -> DataFrame:
    counts = book.lines.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    return J.with_both_sections(counts, book).groupBy("pl_section", "bs_section").agg(A.total("n"))


@register(
    "op_global_agg",
    sql(
        f"""SELECT count(*) AS n, {double("sum(debit)", "debit")}, {double("sum(credit)", "credit")},
            {double("sum(CASE WHEN line_item < 0 THEN debit END)", "nothing")} FROM posted""",
        "posted",
    ),
)
def global_agg(book: Ledger) -> DataFrame:
    return J.posted_lines(book).agg(
        F.count(F.lit(1)).alias("n"),
        _money_sum("debit").alias("debit"),
        _money_sum("credit").alias("credit"),
        _money_sum("CASE WHEN line_item < 0 THEN debit END").alias("nothing"),
    )


# --- sorts ------------------------------------------------------------------


@register(
    "op_sort_hidden_key",
    sql(
        """SELECT pl_section, count(*) AS n FROM chart GROUP BY pl_section, pl_section_id
        ORDER BY pl_section_id NULLS FIRST""",
        "chart",
    ),
)
def sort_hidden_key(book: Ledger) -> DataFrame:
    groups = J.with_pl_section(book.accounts, book).groupBy("pl_section", "pl_section_id")
    return groups.agg(F.count(F.lit(1)).alias("n")).orderBy("pl_section_id").drop("pl_section_id")


@register(
    "op_sort_multi",
    sql(
        """SELECT account_id, account_code, name FROM chart
        ORDER BY is_balance_sheet_section DESC NULLS LAST, bs_section_id NULLS FIRST, account_code NULLS FIRST,
            account_id""",
        "chart",
    ),
)
def sort_multi(book: Ledger) -> DataFrame:
    keys = (F.desc("is_balance_sheet_section"), F.asc("bs_section_id"), F.asc("account_code"))
    return J.chart(book).orderBy(*keys, "account_id").select("account_id", "account_code", "name")


@register(
    "op_sort_stored",
    sql(
        """SELECT row_number() OVER (ORDER BY is_balance_sheet_section DESC NULLS LAST, bs_section_id NULLS FIRST,
            account_code NULLS FIRST, account_id) AS position, account_id, account_code, name FROM chart""",
        "chart",
    ),
)
def sort_stored(book: Ledger) -> DataFrame:
    """The order of a sorted report, as its files keep it."""
    spark = book.accounts.sparkSession
    path = staging_path(spark, "sorted")
    save_sorted(sort_multi(book), path)
    return load_sorted(spark, path)


# --- expressions ------------------------------------------------------------

_LINE_KEY = "journal_entry_id, account_id, line_item"
_KEY = _LINE_KEY.split(", ")


@register(
    "op_ifnull",
    sql(f"""SELECT {_LINE_KEY}, {double("coalesce(debit, 0)", "debit")}, {double("coalesce(credit, 0)", "credit")}
        FROM lines""", "lines"),
)
def ifnull(book: Ledger) -> DataFrame:
    return book.lines.select(*_KEY, *[M.money(M.or_zero(F.col(side))).alias(side) for side in ("debit", "credit")])


@register("op_year", sql("SELECT journal_entry_id, CAST(year(entry_date) AS INTEGER) AS entry_year FROM entries", "entries"))
def year(book: Ledger) -> DataFrame:
    return book.entries.select("journal_entry_id", F.year("entry_date").alias("entry_year"))


@register(
    "op_round",
    sql(f"SELECT {_LINE_KEY}, {double('round(debit * 0.25, 2)', 'quarter')} FROM lines", "lines"),
)
def round_row(book: Ledger) -> DataFrame:
    return book.lines.select(*_KEY, M.money(F.col("debit") * F.lit(Decimal("0.25"))).alias("quarter"))


@register(
    "op_case",
    sql(
        f"""SELECT {_LINE_KEY},
            CASE WHEN credit IS NULL THEN 'no credit' WHEN debit IS NULL THEN 'no debit' END AS without_else,
            CASE WHEN credit IS NULL THEN 1 WHEN debit IS NULL THEN -1 ELSE 0 END AS with_else
        FROM lines""",
        "lines",
    ),
)
def case(book: Ledger) -> DataFrame:
    debit, credit = _c("debit", "credit")
    return book.lines.select(
        *_KEY,
        F.when(credit.isNull(), "no credit").when(debit.isNull(), "no debit").alias("without_else"),
        F.when(credit.isNull(), 1).when(debit.isNull(), -1).otherwise(0).alias("with_else"),
    )


@register(
    "op_signed_amount",
    sql(f"SELECT journal_entry_id, line_item, account_id, {double('pl_amount', 'amount')} FROM posted", "posted"),
)
def signed_amount(book: Ledger) -> DataFrame:
    rows = J.with_pl_section(J.with_accounts(J.posted_lines(book), book), book)
    amount = M.money(M.pl_amount(*_c("debit", "credit", "debit_is_positive")))
    return rows.select("journal_entry_id", "line_item", "account_id", amount.alias("amount"))


def _lone_sides():
    debit, credit = _c("debit", "credit")
    return F.col("name_key"), M.lone_debit(debit, credit), M.lone_credit(debit, credit)


@register(
    "op_side_measures",
    sql(
        f"""SELECT journal_entry_id, line_item, account_id, {double("asset", "assets")},
            {double("liability", "liabilities")}, {double("owned", "equity")} FROM posted""",
        "posted",
    ),
)
def side_measures(book: Ledger) -> DataFrame:
    sides = {"assets": M.asset_amount, "liabilities": M.liability_amount, "equity": M.equity_amount}
    amounts = [M.money(measure(*_lone_sides())).alias(label) for label, measure in sides.items()]
    return J.master(book).select("journal_entry_id", "line_item", "account_id", *amounts)


@register(
    "op_bs_amount",
    sql(f"SELECT journal_entry_id, line_item, account_id, {double('sheet_amount', 'amount')} FROM posted", "posted"),
)
def bs_amount(book: Ledger) -> DataFrame:
    amount = M.money(M.bs_amount(*_lone_sides())).alias("amount")
    return J.master(book).select("journal_entry_id", "line_item", "account_id", amount)


@register(
    "op_yoy_pct",
    sql(
        f"""SELECT account_code, {oracle.TWO_YEARS}
        FROM (SELECT account_code, sum(CASE WHEN entry_year = {YEAR} THEN balance ELSE 0 END) AS q,
                sum(CASE WHEN entry_year = {YEAR - 1} THEN balance ELSE 0 END) AS p
              FROM posted GROUP BY 1) t""",
        "posted",
    ),
)
def growth(book: Ledger) -> DataFrame:
    def balance(prefix: str):
        return F.sum(F.col(prefix + "lone_debit") - F.col(prefix + "lone_credit"))

    totals = A.per_account(A.amounts_of(book), A.lone_measures(YEAR, "query_") | A.lone_measures(YEAR - 1, "previous_"))
    by_code = J.with_accounts(totals, book).groupBy("account_code")
    sums = by_code.agg(balance("query_").alias("query"), balance("previous_").alias("previous"))
    query, previous = _c("query", "previous")
    return sums.select(
        "account_code",
        M.money(query).alias("query_year"),
        M.money(previous).alias("previous_year"),
        M.yoy_pct(query, previous).alias("yoy_growth_pct"),
    )


@register(
    "op_div_zero",
    sql(
        f"""SELECT {_LINE_KEY}, {double("credit", "credit")}, {oracle.percent("credit", "debit")} AS pct
        FROM (SELECT {_LINE_KEY}, coalesce(debit, 0) AS debit, coalesce(credit, 0) AS credit FROM lines) t""",
        "lines",
    ),
)
def div_zero(book: Ledger) -> DataFrame:
    debit, credit = (M.or_zero(side) for side in _c("debit", "credit"))
    return book.lines.select(*_KEY, M.money(credit).alias("credit"), M.yoy_pct(credit, debit).alias("pct"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
