"""Amounts of many digits: a total is right or raises, in ANSI mode or not."""

from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import finstat
from finstat.functions.measures import yoy_pct
from finstat.operators import amounts as A
from tests.conftest import make_ledger, rows
from tests.test_sources import posted_to_cash

pytestmark = pytest.mark.parametrize("ansi", ["true", "false"])


@pytest.fixture(autouse=True)
def mode(conf, ansi):
    conf(spark__sql__ansi__enabled=ansi)


@pytest.mark.parametrize(
    "debits, kind",
    [
        (["1e30", "5"], "decimal(38,2)"),
        (["1e27", "5"], "decimal(38,8)"),
        (["9" * 27 + ".99999999", "-" + "9" * 27 + ".99999999", "0.01"], "decimal(38,8)"),
        (["9" * 33 + ".25", "-" + "9" * 33 + ".25", "7"], "decimal(38,2)"),
        (["9" * 17] * 40, "decimal(17,0)"),
    ],
)
def test_totals_are_right(spark, micro, debits, kind):
    debits = [Decimal(d) for d in debits]
    book = posted_to_cash(spark, micro, debits, kind)
    exact = sum(map(Fraction, debits))
    want = float(exact)
    assert rows(finstat.accounting_equation(book, 2016))[0][0] == want
    assert rows(finstat.bs_yoy(book, 2016))[0][:3] == ("CURRENT ASSETS", want, 0.0)
    assert ("balance sheet", "CURRENT ASSETS", want, 0.0, 100.0) in rows(finstat.statement_rows(book, 2016))
    assert Fraction(finstat.rollup(book).first().debit) == exact


@pytest.mark.parametrize(
    "debits, kind",
    [
        (["1e28", "5"], "decimal(38,8)"),  # no amount of 36 digits
        (["1e35", "5"], "decimal(38,2)"),
        (["9" * 28] * 2, "decimal(38,8)"),  # amounts that fit, and a total that does not
        (["9" * 34] * 2, "decimal(38,2)"),
        (["9" * 34] * 2000, "decimal(38,2)"),
    ],
)
def test_what_does_not_fit_raises(spark, micro, debits, kind):
    book = posted_to_cash(spark, micro, [Decimal(d) for d in debits], kind)
    for report in (finstat.accounting_equation, finstat.bs_yoy, finstat.statement_rows):
        with pytest.raises(Exception, match="does not fit|no amount of|OVERFLOW|OUT_OF_RANGE"):
            rows(report(book, 2016))


def test_totals_of_accounts_that_do_not_fit_together_raise(spark, micro):
    """Each account's total fits, that of their section does not."""
    lines = [(1, account, 1, None, Decimal("6e33"), None) for account in (101, 102)]
    book = make_ledger(spark, lines=lines, money=A.money_sum(2))
    with pytest.raises(Exception, match="does not fit|OVERFLOW|OUT_OF_RANGE"):
        lines = [(1, 101 + n % 2, n, None, Decimal("9.9e33"), None) for n in range(3)]
        rows(finstat.accounting_equation(make_ledger(spark, lines=lines, money=A.money_sum(2)), 2016))
    assert rows(finstat.accounting_equation(book, 2016))[0][0] == 1.2e34


def test_a_ledger_that_was_not_conformed(spark, micro):
    """The sides are made exact where the amounts are read, whoever built the ledger."""
    lines = spark.createDataFrame([(1, 101, 1, Decimal("1e30")), (1, 101, 2, Decimal(5))], "journal_entry_id long, account_id long, line_item int, debit decimal(38,2)")
    book = finstat.Ledger(lines.withColumn("credit", F.lit(None).cast("decimal(38,2)")), micro.entries, micro.accounts, micro.sections)
    assert rows(finstat.accounting_equation(book, 2016))[0][0] == 1e30


def test_bigint_parts_that_overflow_raise(spark):
    big = spark.range(10).select(F.lit(2**62).alias("u"))
    assert big.agg(A.sum_units("u", 2).alias("s")).first().s == Decimal(10 * 2**62).scaleb(-2)
    parts = spark.range(3).select(F.lit(2**62).alias("u"))
    with pytest.raises(Exception, match="does not fit"):
        parts.agg(F.expr(A.fitting("try_sum(u)", "count(u) > 0"))).collect()
    assert parts.limit(0).agg(A.sum_units("u", 2).alias("s")).first().s is None


def test_change_of_wide_amounts(spark):
    frame = spark.createDataFrame([(Decimal("3e33"), Decimal("1e33")), (Decimal("3.33"), Decimal("1.11"))], "now decimal(36,2), then decimal(36,2)")
    assert [r[0] for r in frame.select(yoy_pct(F.col("now"), F.col("then"))).collect()] == [66.67, 66.67]


def test_a_line_keeps_its_side(spark, micro):
    """An amount that does not fit is no NULL, which would move the line to the other side."""
    lines = spark.createDataFrame(
        [(1, 101, 1, Decimal("1e35"), Decimal(5))], "journal_entry_id long, account_id long, line_item int, debit decimal(38,2), credit decimal(38,2)"
    )
    with pytest.raises(Exception, match="no amount of"):
        rows(finstat.accounting_equation(finstat.ledger(lines, micro.entries, micro.accounts, micro.sections), 2016))
