"""Relations between the reports, on the generated tables."""

import pytest
from pyspark.sql import functions as F

import finstat
from tests.conftest import ordered, rows

YEARS = (2000, 1995, 2002)


@pytest.fixture(scope="module")
def stored(book, staged):
    return staged(book)


@pytest.mark.parametrize("fy", YEARS)
@pytest.mark.parametrize(
    "report", ["pl_one_year", "pl_yoy", "section_crosstab", "bs_by_account", "accounting_equation", "bs_yoy"]
)
def test_rollup_equals_lines(book, stored, report, fy):
    run = getattr(finstat, report)
    assert ordered(rows(run(book, fy, amounts=stored))) == ordered(rows(run(book, fy)))


def test_pl_by_year_from_rollup(book, stored):
    assert ordered(rows(finstat.pl_by_year(book, amounts=stored))) == ordered(rows(finstat.pl_by_year(book)))


def test_rollup_has_one_row_per_account_and_year(stored):
    assert stored.count() == stored.select("account_id", "fiscal_year").distinct().count()


def test_one_year_is_the_query_year_of_the_two_year_report(book, stored):
    one = dict(rows(finstat.pl_one_year(book, 2000, amounts=stored)))
    two = {row[0]: row[1] for row in rows(finstat.pl_yoy(book, 2000, amounts=stored))}
    assert one == {name: two[name] for name in one}


def test_all_years_agree_with_each_year(book, stored):
    by_year = {(name, year): amount for name, year, amount in rows(finstat.pl_by_year(book, amounts=stored))}
    for year in {year for _, year in by_year}:
        one = {name: amount for name, amount in rows(finstat.pl_one_year(book, year, amounts=stored)) if name.strip()}
        assert one == {name: amount for (name, other), amount in by_year.items() if other == year}


def test_crosstab_counts_the_master_table(book, stored):
    counted = sum(row[2] for row in rows(finstat.section_crosstab(book, 2000, amounts=stored)))
    assert counted == finstat.master_lines(book, 2000).count() == finstat.master_classified(book, 2000).count()


def test_classified_lines_add_up_to_the_equation(book, stored):
    assets, _, liabilities, _, equity = rows(finstat.accounting_equation(book, 2000, amounts=stored))[0]
    lines = rows(finstat.master_classified(book, 2000).select("assets", "liabilities", "equity"))
    sums = [round(sum(column), 2) for column in zip(*lines)]
    assert sums == pytest.approx([assets, liabilities, equity], abs=0.01)


def test_pl_filters_agree_where_names_are_not_blank(book, stored):
    by_id = [row for row in rows(finstat.pl_yoy(book, 2000, amounts=stored)) if row[0].strip()]
    assert by_id == rows(finstat.pl_yoy(book, 2000, section_filter="nonblank", amounts=stored))


@pytest.mark.parametrize("partitions", [1, 13])
def test_results_do_not_depend_on_partitioning(book, partitions, spark):
    shuffled = finstat.Ledger(
        book.lines.repartition(partitions, "line_item"), book.entries.repartition(partitions), book.accounts, book.sections
    )
    assert rows(finstat.pl_yoy(shuffled, 2000)) == rows(finstat.pl_yoy(book, 2000))
    assert rows(finstat.bs_yoy(shuffled, 2000)) == rows(finstat.bs_yoy(book, 2000))


def test_master_classified_is_sorted(book):
    """By sheet flag (NULL last), section id (NULL first), and entry code."""
    from finstat.operators import joins

    # Account names are not unique in the tables; here they have to identify a line.
    named = finstat.Ledger(
        book.lines, book.entries, book.accounts.withColumn("account", F.col("account_id").cast("string")), book.sections
    )
    hidden = joins.with_both_sections(named.accounts.select("account_id"), named)
    keys = {row.account: row for row in hidden.collect()}
    order = []
    for line in finstat.master_classified(named, 2000).collect():
        flag, section = keys[line.account].is_balance_sheet_section, keys[line.account].bs_section_id
        order.append((flag is None, -(flag or 0), section is not None, section or 0, line.journal_entry_code))
    assert order == sorted(order)
