"""The shape of the physical plans."""

import re

import pytest

import finstat
from finstat.plans import statements
from finstat.sources.ledger import TABLES


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def formatted(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def scans(text, *columns):
    """How many scans read all of the columns; locations are cut in a plan's text, the columns of a scan are not."""
    return sum(all(f"{c}#" in read for c in columns) for read in re.findall(r"FileScan parquet \[([^\]]*)\]", text))


@pytest.fixture
def big(conf, spark, stored_folders):
    """Plans on a stored ledger as on a cluster: dimensions small enough to broadcast, header and fact not."""
    conf(spark__sql__autoBroadcastJoinThreshold="150000")
    return finstat.from_parquet(spark, stored_folders[0])


SUMMED = {
    "pl_by_year": lambda b: finstat.pl_by_year(b),
    "pl_one_year": lambda b: finstat.pl_one_year(b, 2000),
    "pl_yoy": lambda b: finstat.pl_yoy(b, 2000),
    "section_totals": lambda b: finstat.section_totals(b, 2000),
    "section_crosstab": lambda b: finstat.section_crosstab(b, 2000),
    "bs_by_account": lambda b: finstat.bs_by_account(b, 2000),
    "accounting_equation": lambda b: finstat.accounting_equation(b, 2000),
    "bs_yoy": lambda b: finstat.bs_yoy(b, 2000),
    "line_count": lambda b: finstat.line_count(b, 2000),
    "statement_rows": lambda b: finstat.statement_rows(b, 2000),
}
DETAIL = {
    "master_lines": lambda b: finstat.master_lines(b, 2000),
    "master_classified": lambda b: finstat.master_classified(b, 2000),
}
ALL = {**SUMMED, **DETAIL}


@pytest.mark.parametrize("name", ALL)
def test_no_cartesian_and_no_python(big, name):
    text = plan(ALL[name](big))
    for operator in ("Cartesian", "NestedLoop", "Python", "InPandas", "Window"):
        assert operator not in text


@pytest.mark.parametrize("name", ALL)
def test_fact_is_scanned_once_and_shuffled_once(big, name):
    """The only shuffle of single lines is the one of the join with their entries."""
    text = plan(ALL[name](big))
    assert scans(text, "journal_entry_id", "account_id") == 1
    assert text.count("SortMergeJoin") == 1
    assert len(re.findall(r"Exchange hashpartitioning\(journal_entry_id", text)) == 2


@pytest.mark.parametrize("name", SUMMED)
def test_postings_are_totalled_before_they_meet_the_dimensions(big, name):
    """Partial sums per account sit right above the entry join, below every other join."""
    text = plan(SUMMED[name](big))
    partial = text.index("HashAggregate(keys=[account_id")
    merge = text.index("SortMergeJoin")
    assert partial < merge
    assert not re.search(r"Exchange|Join", text[text.rindex("HashAggregate(", 0, merge):merge])


@pytest.mark.parametrize("name", SUMMED)
def test_accounts_beyond_a_broadcast(conf, big, name):
    """With accounts too many to broadcast, what is shuffled on account is totals, not lines."""
    conf(spark__sql__autoBroadcastJoinThreshold="10000")
    text = plan(SUMMED[name](big))
    assert len(re.findall(r"Exchange hashpartitioning\(journal_entry_id", text)) == 2
    lines = text.splitlines()
    shuffled = [lines[n + 1] for n, line in enumerate(lines) if "Exchange hashpartitioning(account_id" in line]
    assert len(shuffled) >= 2
    assert all(re.search(r"HashAggregate|section_id|Filter isnotnull\(account_id", line) for line in shuffled)


TWO_YEARS = ["bs_yoy", "pl_yoy", "statement_rows"]
ONE_YEAR = sorted(set(ALL) - {"pl_by_year", *TWO_YEARS})


@pytest.mark.parametrize("name", ONE_YEAR)
def test_lines_of_other_years_are_dropped_before_the_shuffle(big, conf, name):
    """Nothing is broadcast; a Bloom filter of the year's entries stands on the lines' side."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0",
    )
    text = formatted(ALL[name](big))
    filters = [line for line in text.splitlines() if "might_contain" in line]
    assert any("xxhash64(journal_entry_id" in line for line in filters)


@pytest.mark.parametrize("name", ONE_YEAR)
def test_a_ledger_stored_by_year_prunes_its_lines(spark, stored_folders, name):
    text = formatted(ALL[name](finstat.load_ledger(spark, stored_folders[1])))
    assert re.search(r"PartitionFilters: \[isnotnull\(entry_year#\d+\), \(entry_year#\d+ = 2000\)\]", text)


@pytest.mark.parametrize("name", TWO_YEARS)
def test_two_year_reports_read_two_years_of_a_stored_ledger(spark, stored_folders, name):
    """What has lines in other years comes from the stored ids of posted accounts."""
    stored = finstat.load_ledger(spark, stored_folders[1])
    text = formatted(ALL[name](stored))
    years = r"PartitionFilters: \[isnotnull\(entry_year#\d+\), \(entry_year#\d+ >= 1999\), \(entry_year#\d+ <= 2000\)\]"
    assert re.search(years, text)
    pushed = [line for line in text.splitlines() if "PushedFilters" in line]
    assert any("GreaterThanOrEqual(entry_date,1999-01-01" in p and "LessThan(entry_date,2001-01-01" in p for p in pushed)
    assert scans(plan(ALL[name](stored)), "journal_entry_id", "account_id") == 1


def test_all_statements_come_from_one_pass(big, tmp_path):
    """One scan of the lines and of the entries, one shuffle of each; nothing is written."""
    rows = finstat.financial_statements(big, 2000).rows
    text = plan(rows)
    assert scans(text, "journal_entry_id") == 2
    assert text.count("SortMergeJoin") == 1
    assert len(re.findall(r"Exchange hashpartitioning\(journal_entry_id", text)) == 2
    assert text.count("Generate inline") == 1
    before = {p: p.stat().st_mtime for p in tmp_path.parent.rglob("*.parquet")}
    rows.collect()
    assert {p: p.stat().st_mtime for p in tmp_path.parent.rglob("*.parquet")} == before


def test_scans_are_counted_under_a_long_folder(spark, micro, tmp_path):
    folder = str(tmp_path / ("long" * 40))
    for role, (table, _) in TABLES.items():
        getattr(micro, role).write.parquet(f"{folder}/{table}")
    assert scans(plan(finstat.pl_yoy(finstat.from_parquet(spark, folder), 2016)), "journal_entry_id", "account_id") == 1


@pytest.mark.parametrize("key", ["op_derived_table", "op_outer_filter"])
def test_counts_are_taken_before_the_dimensions(big, conf, key):
    """With accounts beyond a broadcast, no single line is shuffled a second time."""
    from finstat.registry.queries import REPORTS

    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(REPORTS[key](big))
    lines = text.splitlines()
    shuffled = [lines[n + 1] for n, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\((journal_entry_id|account_id)", line)]
    assert sum("journal_entry_id" in line and "HashAggregate" not in line for line in shuffled) == 2
    assert sum("HashAggregate" in line for line in shuffled) >= 1


def test_null_rejecting_filters_make_inner_joins(big):
    # The one outer join left gives the sections of the result their names.
    assert plan(finstat.pl_yoy(big, 2000)).count("LeftOuter") == 1


def test_either_section_keeps_the_dimension_joins_outer(big):
    text = plan(finstat.section_crosstab(big, 2000))
    # Three joins with the dimensions, and two that give the groups their names.
    assert text.count("LeftOuter") == 5
    assert re.search(r"SortMergeJoin \[journal_entry_id.*Inner", text)


def test_year_reaches_the_scan_as_a_range(big):
    pushed = [line for line in formatted(finstat.accounting_equation(big, 2000)).splitlines() if "PushedFilters" in line]
    ranges = [line for line in pushed if "GreaterThanOrEqual(entry_date,2000-01-01" in line and "LessThan(entry_date,2001-01-01" in line]
    assert len(ranges) == 1


def test_only_used_columns_are_read(big):
    text = formatted(finstat.accounting_equation(big, 2000))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any("profit_loss_section_id" in s and "account_code" not in s for s in schemas)
    assert not any("description" in s or "journal_entry_code" in s for s in schemas)


def test_stored_rollup_prunes_years(book, staged):
    stored = staged(book)
    text = formatted(statements.accounting_equation(book, 2000, amounts=stored))
    assert re.search(r"PartitionFilters: \[isnotnull\(fiscal_year#\d+\), \(fiscal_year#\d+ = 2000\)\]", text)
    assert "lineitem" not in text


def test_statements_read_the_stored_rollup_only(book, staged):
    parts = finstat.financial_statements(book, 2000, amounts=staged(book))
    for frame in (parts.profit_loss, parts.balance_sheet, parts.equation):
        text = plan(frame)
        assert "lineitem" not in text and "orders" not in text


def test_sort_cuts_through_an_entry(big):
    exchange = re.search(r"Exchange rangepartitioning\((.*?)\), ENSURE", plan(finstat.master_classified(big, 2000))).group(1)
    assert "line_item" in exchange and "account_id" in exchange


def test_status_flags_reach_the_scan_of_a_stored_ledger(spark, micro, tmp_path):
    """Conforming a table casts its columns; casts to their own type must not block pushdown."""
    for role, (table, _) in TABLES.items():
        getattr(micro, role).write.parquet(str(tmp_path / table))
    text = formatted(finstat.pl_one_year(finstat.from_parquet(spark, str(tmp_path)), 2016))
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line and "debit_credit_balanced" in line)
    for condition in (
        "EqualTo(debit_credit_balanced,1)",
        "Not(EqualTo(user_id,0))",
        "EqualTo(closing_type,0)",
        "EqualTo(cancelled,0)",
        "GreaterThanOrEqual(entry_date,2016-01-01)",
        "LessThan(entry_date,2017-01-01)",
    ):
        assert condition in pushed


@pytest.mark.parametrize("name", SUMMED)
def test_aggregates_stay_in_generated_code(big, name):
    """Hash aggregates all through: no sort-based or object-based ones."""
    text = plan(SUMMED[name](big))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
