"""All statements from one pass, and two-year reports that read two years."""

import pytest

import finstat
from finstat.sources import tpch
from finstat.sources.ledger import POSTED_ACCOUNTS, save_posted_accounts
from tests.conftest import TESTDATA, rows

YEARS = (2016, 2015, 2017, 2018, 1990)


def one_by_one(book, fy, **options):
    """The rows of the three statements, each from its own report."""
    pl = {k: v for k, v in options.items() if k in ("section_filter", "base", "netting")} | {"section_filter": options.get("section_filter", "nonblank")}
    bs = {k: v for k, v in options.items() if k in ("base", "asset_credits")}
    assets, _, liabilities, _, equity = rows(finstat.accounting_equation(book, fy))[0]
    return [
        *[("profit and loss", *row) for row in rows(finstat.pl_yoy(book, fy, **pl))],
        *[("balance sheet", *row) for row in rows(finstat.bs_yoy(book, fy, **bs))],
        *[("equation", item, amount, None, None) for item, amount in (("assets", assets), ("liabilities", liabilities), ("equity", equity))],
    ]


@pytest.mark.parametrize(
    "options",
    [{}, {"netting": True}, {"base": "previous"}, {"asset_credits": True}, {"section_filter": "id"}, {"section_filter": "name"}],
)
def test_rows_equal_the_single_reports(micro, options):
    for fy in YEARS:
        assert rows(finstat.financial_statements(micro, str(fy), **options).rows) == one_by_one(micro, fy, **options)


def test_rows_of_a_generated_ledger(book, staged):
    amounts = staged(book)
    for fy in (2000, 1995, 2002, 1980):
        want = one_by_one(book, fy)
        assert rows(finstat.statement_rows(book, fy)) == want
        assert rows(finstat.statement_rows(book, fy, amounts)) == want


def test_rows_of_an_empty_ledger(micro):
    empty = finstat.Ledger(micro.lines.limit(0), micro.entries, micro.accounts, micro.sections)
    assert rows(finstat.statement_rows(empty, 2016)) == [("equation", item, None, None, None) for item in ("assets", "liabilities", "equity")]


@pytest.fixture(scope="module")
def layouts(spark, tmp_path_factory):
    """A ledger, and the same one stored with its posted accounts."""
    generated = tpch.load_ledger(spark, f"{TESTDATA}/sf0.01")
    folder = str(tmp_path_factory.mktemp("posted") / "ledger")
    finstat.save_ledger(generated, folder)
    return generated, folder


def test_posted_accounts_are_those_with_lines_that_count(spark, layouts):
    generated, folder = layouts
    ids = [row[0] for row in rows(finstat.load_ledger(spark, folder).posted_accounts)]
    want = {row.account_id for row in finstat.rollup(generated).collect()} - {None}
    assert len(ids) == len(set(ids)) and set(ids) == want


@pytest.mark.parametrize("fy", [2000, 1995, 2001, 2002, 1970, 2040])
def test_two_years_are_enough(spark, layouts, fy):
    generated, folder = layouts
    known = finstat.load_ledger(spark, folder)
    for report in (finstat.pl_yoy, finstat.bs_yoy, finstat.statement_rows):
        assert rows(report(known, fy)) == rows(report(generated, fy)), report
    assert rows(finstat.pl_yoy(known, fy, section_filter="nonblank", netting=True)) == rows(
        finstat.pl_yoy(generated, fy, section_filter="nonblank", netting=True)
    )


def test_other_years_are_not_read(spark, layouts, tmp_path):
    """Without the folders of the other years the two-year reports are the same."""
    import shutil

    folder = tmp_path / "ledger"
    shutil.copytree(layouts[1], folder)
    for year in (folder / "journal_entry_line_item").glob("entry_year=*"):
        if year.name not in ("entry_year=2000", "entry_year=1999"):
            shutil.rmtree(year)
    part, whole = finstat.load_ledger(spark, str(folder)), finstat.load_ledger(spark, layouts[1])
    for report in (finstat.pl_yoy, finstat.bs_yoy, finstat.statement_rows):
        assert rows(report(part, 2000)) == rows(report(whole, 2000))


def test_a_layout_without_the_table_reads_all_years(spark, micro, tmp_path):
    import shutil

    folder = str(tmp_path / "ledger")
    finstat.save_ledger(micro, folder)
    shutil.rmtree(f"{folder}/{POSTED_ACCOUNTS}")
    old = finstat.load_ledger(spark, folder)
    assert old.posted_accounts is None
    assert rows(finstat.pl_yoy(old, 2016)) == rows(finstat.pl_yoy(micro, 2016))
    save_posted_accounts(spark, folder)
    assert finstat.load_ledger(spark, folder).posted_accounts is not None
