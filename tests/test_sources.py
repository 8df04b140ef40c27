"""Reading a ledger from files and tables, and querying it with SQL."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import finstat
from finstat import schema
from finstat.session import shared_folder
from finstat.sources.ledger import TABLES
from tests.conftest import rows


def write(book, folder, source, **options):
    for role, (table, _) in TABLES.items():
        getattr(book, role).write.format(source).options(**options).save(f"{folder}/{table}")


@pytest.mark.parametrize(
    "source, options",
    [("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"emptyValue": "", "nullValue": "NULL"})],
)
def test_files(spark, micro, tmp_path, source, options):
    write(micro, tmp_path, source, **options)
    book = finstat.from_files(spark, str(tmp_path), source, **options)
    assert rows(finstat.pl_yoy(book, 2016)) == rows(finstat.pl_yoy(micro, 2016))
    assert rows(finstat.bs_yoy(book, 2016)) == rows(finstat.bs_yoy(micro, 2016))


def test_parquet_with_foreign_types(spark, micro, tmp_path):
    """Money as double, flags as smallint, dates as timestamps, no description."""
    lines = micro.lines.select(
        "journal_entry_id", "account_id", "line_item", F.col("debit").cast("double"), F.col("credit").cast("double")
    )
    entries = micro.entries.withColumn("entry_date", F.col("entry_date").cast("timestamp"))
    entries = entries.withColumn("cancelled", F.col("cancelled").cast("smallint"))
    frames = {"lines": lines, "entries": entries, "accounts": micro.accounts, "sections": micro.sections}
    for role, (table, _) in TABLES.items():
        frames[role].write.parquet(str(tmp_path / table))
    book = finstat.from_parquet(spark, str(tmp_path))
    assert book.lines.schema["debit"].dataType == schema.FLOAT_MONEY
    assert rows(finstat.accounting_equation(book, 2016)) == [(70.0, "=", 20.0, "+", 78.0)]


def test_tables(spark, micro):
    spark.sql("CREATE DATABASE IF NOT EXISTS ledger_test")
    for role, (table, _) in TABLES.items():
        getattr(micro, role).write.mode("overwrite").saveAsTable(f"ledger_test.{table}")
    book = finstat.from_tables(spark, "ledger_test")
    assert rows(finstat.line_count(book, 2016)) == [(20,)]


def test_views(spark, micro):
    finstat.register_views(micro)
    found = spark.sql(
        """SELECT count(*) FROM journal_entry_line_item l
           LEFT JOIN journal_entry e ON e.journal_entry_id = l.journal_entry_id
           WHERE year(e.entry_date) = :fy""",
        args={"fy": 2016},
    )
    assert rows(found) == [(20,)]
    assert rows(finstat.line_count(finstat.from_tables(spark), 2016)) == [(20,)]


def test_saved_rollup(spark, micro, tmp_path):
    path = str(tmp_path / "rollup")
    finstat.save_rollup(finstat.rollup(micro), path)
    stored = finstat.load_rollup(spark, path)
    cash = stored.filter("account_id = 101 AND fiscal_year = 2016").first()
    assert (cash.n_lines, cash.debit, cash.credit) == (2, Decimal("100.00"), Decimal("30.00"))
    assert (cash.lone_debit, cash.lone_credit) == (Decimal("100.00"), Decimal("30.00"))
    sales = stored.filter("account_id = 106 AND fiscal_year = 2015").first()
    assert sales.debit is None


def test_rollup_of_no_lines(spark, micro, tmp_path):
    path = str(tmp_path / "rollup")
    empty = finstat.Ledger(micro.lines.limit(0), micro.entries, micro.accounts, micro.sections)
    finstat.save_rollup(finstat.rollup(empty), path)
    stored = finstat.load_rollup(spark, path)
    assert rows(finstat.accounting_equation(empty, 2016, amounts=stored)) == [(None, "=", None, "+", None)]
    assert rows(finstat.pl_yoy(empty, 2016, amounts=stored)) == []


def test_sums_are_exact(spark, micro):
    """A million cents in any order, next to an amount that swallows a cent as a double."""
    big = Decimal("1234567890123456.78")
    lines = spark.range(1_000_000).select(
        F.lit(1).alias("journal_entry_id"),
        F.lit(101).alias("account_id"),
        F.lit(1).alias("line_item"),
        F.when(F.col("id") == 500_000, F.lit(big)).otherwise(F.lit(Decimal("0.01"))).alias("debit"),
        F.lit(None).alias("credit"),
    )
    book = finstat.ledger(lines, micro.entries, micro.accounts, micro.sections)
    total = finstat.rollup(book).first().debit
    assert total == big + Decimal("9999.99")


def test_shared_folder_is_the_session_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def posted_to_cash(spark, micro, debits, kind):
    """A ledger of one entry of 2016 with the given debits on the cash account."""
    lines = spark.createDataFrame([(1, 101, n, d) for n, d in enumerate(debits)], f"journal_entry_id long, account_id long, line_item int, debit {kind}")
    return finstat.ledger(lines.withColumn("credit", F.lit(None)), micro.entries, micro.accounts, micro.sections)


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    "debits, kind, assets",
    [
        ([0.005] * 4, "double", 0.02),
        ([0.004] * 100, "double", 0.4),
        ([Decimal("0.005")] * 4, "decimal(18,3)", 0.02),
        ([Decimal("0.004")] * 100, "decimal(30,8)", 0.4),
        (["0.005", "0.005", "1.99"], "string", 2.0),
        ([3, 4], "long", 7.0),
        ([0.1, 0.2, None], "double", 0.3),
    ],
)
def test_amounts_are_rounded_after_the_sum(spark, micro, conf, debits, kind, assets, ansi):
    conf(spark__sql__ansi__enabled=ansi)
    book = posted_to_cash(spark, micro, debits, kind)
    assert rows(finstat.accounting_equation(book, 2016))[0][0] == assets


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    "debit, kind",
    [(1e17, "double"), (float("nan"), "double"), (float("inf"), "double"), ("1,000.00", "string"), ("", "string"), (10**13, "long")],
)
def test_amounts_that_do_not_fit_raise(spark, micro, conf, debit, kind, ansi):
    conf(spark__sql__ansi__enabled=ansi)
    book = posted_to_cash(spark, micro, [5, debit] if kind == "long" else [debit], kind)
    with pytest.raises(Exception, match="no amount of"):
        rows(finstat.accounting_equation(book, 2016))


def test_text_files_keep_decimals(spark, micro, tmp_path):
    for role, (table, _) in TABLES.items():
        frame = getattr(micro, role)
        if role == "lines":
            frame = frame.withColumn("debit", F.when(F.col("debit").isNotNull(), F.lit("0.005")))
        frame.write.option("nullValue", "NULL").option("emptyValue", "").csv(str(tmp_path / table))
    book = finstat.from_files(spark, str(tmp_path), "csv", nullValue="NULL", emptyValue="")
    assert finstat.rollup(book).filter("account_id = 101 AND fiscal_year = 2016").first().debit == Decimal("0.005")


def test_scales_beyond_the_totals_are_refused(spark, micro):
    with pytest.raises(ValueError, match="decimals"):
        posted_to_cash(spark, micro, [Decimal(1)], "decimal(38,18)")


def test_stored_by_year(spark, micro, tmp_path):
    """The layout by year gives equal results, also for lines without an entry or a date."""
    from pyspark.sql.types import DateType

    undated = finstat.Ledger(
        micro.lines,
        micro.entries.withColumn("entry_date", F.when(F.col("journal_entry_id") != 2, F.col("entry_date")).cast(DateType())),
        micro.accounts,
        micro.sections,
    )
    folder = str(tmp_path / "ledger")
    finstat.save_ledger(undated, folder)
    stored = finstat.load_ledger(spark, folder)
    assert stored.lines.count() == undated.lines.count()
    for name in ("line_count", "section_totals", "pl_one_year", "pl_yoy", "section_crosstab", "master_lines", "bs_by_account", "accounting_equation", "bs_yoy"):
        report = getattr(finstat, name)
        for fy in (2016, "2015", 1990):
            fy = int(fy) if name == "line_count" else fy
            assert sorted(map(repr, rows(report(stored, fy)))) == sorted(map(repr, rows(report(undated, fy)))), (name, fy)


def test_refreshed_year_equals_a_rebuild(spark, micro, tmp_path):
    path, rebuilt = str(tmp_path / "rollup"), str(tmp_path / "rebuilt")
    finstat.save_rollup(finstat.rollup(micro), path)
    changed = finstat.Ledger(micro.lines.filter("line_item <> 1").union(micro.lines.filter("line_item = 7")), micro.entries, micro.accounts, micro.sections)
    finstat.refresh_rollup(changed, path, "2016")
    finstat.save_rollup(finstat.rollup(changed), rebuilt)
    got, want = (sorted(map(repr, rows(finstat.load_rollup(spark, p)))) for p in (path, rebuilt))
    assert got == want
    gone = finstat.Ledger(micro.lines.limit(0), micro.entries, micro.accounts, micro.sections)
    finstat.refresh_rollup(gone, path, 2016)
    assert finstat.load_rollup(spark, path).filter("fiscal_year = 2016").count() == 0
    assert finstat.load_rollup(spark, path).count() > 0


def test_dates_at_year_ends(spark, micro):
    book = micro.entries.filter(F.col("journal_entry_id").isin(1, 2, 3, 9)).select("entry_date")
    from finstat.functions.predicates import in_year

    kept = [row[0] for row in rows(book.filter(in_year("entry_date", 2016)))]
    assert sorted(kept) == [datetime.date(2016, 1, 1), datetime.date(2016, 12, 31)]


def test_bucketed_tables_join_without_a_shuffle(spark, micro, conf):
    """Tables bucketed alike on the entry id need no exchange for the line-entry join."""
    spark.sql("CREATE DATABASE IF NOT EXISTS ledger_buckets")
    for role, (table, _) in TABLES.items():
        writer = getattr(micro, role).write.mode("overwrite")
        if role in ("lines", "entries"):
            writer = writer.bucketBy(4, "journal_entry_id").sortBy("journal_entry_id")
        writer.saveAsTable(f"ledger_buckets.{table}")
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    book = finstat.from_tables(spark, "ledger_buckets")
    for report in (finstat.pl_yoy, finstat.bs_yoy, finstat.master_lines):
        frame = report(book, 2016)
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [journal_entry_id" in text
        assert "hashpartitioning(journal_entry_id" not in text
        assert sorted(map(repr, rows(frame))) == sorted(map(repr, rows(report(micro, 2016))))
