"""The statements called from SQL."""

import re

import pytest

import finstat
from finstat.registry.queries import REPORTS
from tests.conftest import rows

YEARS = (2000, 1995, 2002, 1970)


def same_as_reports(spark, book, years):
    for fy in years:
        for report in (finstat.pl_yoy, finstat.bs_yoy, finstat.accounting_equation):
            assert rows(spark.sql(f"SELECT * FROM {report.__name__}(fy => {fy})")) == rows(report(book, fy)), (report, fy)
        assert rows(spark.sql("SELECT * FROM financial_statements(:year)", args={"year": fy})) == rows(finstat.statement_rows(book, fy))


def test_functions_equal_the_reports(spark, book):
    finstat.register_functions(book)
    same_as_reports(spark, book, YEARS)
    assert rows(spark.sql("SELECT * FROM pl_yoy(fy => 2000)")) == rows(REPORTS["r05_pl_yoy"](book))


def test_micro_ledger_and_columns(spark, micro):
    finstat.register_functions(micro)
    same_as_reports(spark, micro, (2016, 2015, 2018))
    for report in (finstat.pl_yoy, finstat.bs_yoy, finstat.accounting_equation, finstat.statement_rows):
        name = "financial_statements" if report is finstat.statement_rows else report.__name__
        assert spark.sql(f"SELECT * FROM {name}(2016)").dtypes == report(micro, 2016).dtypes


def test_functions_take_part_in_queries(spark, micro):
    finstat.register_functions(micro)
    found = spark.sql(
        """SELECT a.name, a.query_year - b.query_year AS change
           FROM bs_yoy(2016) a JOIN bs_yoy(2015) b USING (name) WHERE a.name = 'CURRENT ASSETS'"""
    )
    assert len(rows(found)) == 1


@pytest.fixture(scope="module")
def stored(spark, stored_folders):
    return finstat.load_ledger(spark, stored_folders[1])


def test_a_stored_ledger_reads_two_years(spark, stored):
    finstat.register_functions(stored)
    same_as_reports(spark, stored, (2000,))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for name, least in (("pl_yoy", 1999), ("bs_yoy", 1999), ("financial_statements", 1999), ("accounting_equation", 2000)):
        text = spark.sql(f"SELECT * FROM {name}(2000)")._jdf.queryExecution().explainString(mode)
        partitions = [line for line in text.splitlines() if "PartitionFilters" in line and "entry_year" in line]
        assert len(partitions) == 1 and str(least) in partitions[0] and "2000" in partitions[0], (name, partitions)


def test_a_rollup_in_place_of_the_lines(spark, book, staged):
    finstat.register_functions(book, staged(book))
    same_as_reports(spark, book, YEARS[:2])
    text = spark.sql("SELECT * FROM financial_statements(2000)")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("lineitem|l_orderkey", text)


def test_a_year_is_needed(spark, micro):
    finstat.register_functions(micro)
    with pytest.raises(Exception, match="fy|REQUIRED_PARAMETER|WRONG_NUM_ARGS|parameter"):
        spark.sql("SELECT * FROM pl_yoy()").collect()
