"""The account-year rollup: the one aggregate all summed statements can share, and how it is stored.

Stored, a rollup is ``data/batch=<id>/fiscal_year=<year>`` and ``manifest/version=<n>``. A batch is written once and
never changed. A version of the manifest is one small file that names, for every year, the batch that holds it; it is
written last, so a reader sees a version whole or the one before. A job that dies before leaves
a batch that no version names. One writer at a time; batches that no version names any more may be deleted.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstat import schema
from finstat.functions.predicates import fiscal_year
from finstat.operators.amounts import COUNTS, KEYS, SUMS, amounts_of, per_account, plain
from finstat.sources.ledger import Ledger

MANIFEST = "fiscal_year int, batch string, scale int"
NO_YEAR = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder of rows without a year


def rollup(book: Ledger, fy: int | str | None = None) -> DataFrame:
    """The totals of each (account, year) that has posted lines, of all years or of one."""
    fy = None if fy is None else fiscal_year(fy)
    return per_account(amounts_of(book, fy), plain(*SUMS), keys=KEYS)


def save_rollup(amounts: DataFrame, path: str) -> None:
    """Store a rollup as a new version; a version stored before stays until then, whole."""
    spark = amounts.sparkSession
    number, _, _ = _latest(spark, path)
    batch, years = _write_batch(amounts, path)
    _publish(spark, path, number + 1, dict.fromkeys(years, batch), _scale(amounts))


def refresh_rollup(book: Ledger, path: str, fy: int | str) -> None:
    """Compute one year of a stored rollup anew; the other years keep their batches.

    On a ledger that stores the year of its lines (``save_ledger``) only that year's lines are read.
    """
    fy = fiscal_year(fy)
    year = rollup(book, fy)
    _replace(book.lines.sparkSession, path, [fy], year)


def change_rollup(before: Ledger, after: Ledger, path: str) -> None:
    """Bring a stored rollup up to date with changed entries, without reading any other lines.

    ``before`` has the lines of the changed entries, with those entries, as they were when the rollup was stored, ``after``
    as they are now: entries that were added are in ``after`` only, those removed in ``before`` only. The
    old totals are subtracted and the new ones added, as all totals are sums. Only the years they touch are
    read and written. Totals of which fewer lines are left than none raise.
    """
    spark = after.lines.sparkSession
    old = rollup(before)
    gone = old.select("account_id", "fiscal_year", *[(-F.col(name)).alias(name) for name in SUMS])
    delta = rollup(after).unionByName(gone)
    # At most as many rows as there are years.
    years = [row[0] for row in delta.select("fiscal_year").distinct().collect()]
    if not years:
        return
    stored = load_rollup(spark, path)
    if _scale(stored) != _scale(delta):
        raise ValueError(f"the rollup has {_scale(stored)} decimals, the changes have {_scale(delta)}")
    touched = reduce(lambda a, b: a | b, [F.col("fiscal_year").eqNullSafe(F.lit(year).cast("int")) for year in years])
    summed = per_account(stored.filter(touched).unionByName(delta), plain(*SUMS), keys=KEYS)
    short = F.least(*COUNTS) < 0
    lines = F.when(short, F.raise_error(F.lit("the rollup does not have the lines to be taken away"))).otherwise(F.col("n_lines"))
    sides = [F.when(F.col(f"n_{side}") > 0, F.col(side)).alias(side) for side in ("debit", "credit")]
    rest = [c for c in summed.columns if c not in ("n_lines", "debit", "credit")]
    _replace(spark, path, years, summed.select(*rest, lines.alias("n_lines"), *sides).filter("n_lines <> 0"))


def load_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of a stored rollup. Filters on the year reach the folders."""
    number, batches, scale = _latest(spark, path)
    if not number:
        raise FileNotFoundError(f"no rollup in {path}")
    fields = schema.rollup(scale)
    if not batches:
        return spark.createDataFrame([], fields)
    data = f"{path.rstrip('/')}/data"
    folders = [f"{data}/batch={batch}/fiscal_year={NO_YEAR if year is None else year}" for year, batch in batches.items()]
    return spark.read.schema(fields).option("basePath", data).parquet(*folders).select(*fields.names)


def _scale(amounts: DataFrame) -> int:
    return amounts.schema["debit"].dataType.scale


def _latest(spark: SparkSession, path: str) -> tuple[int, dict[int | None, str], int]:
    """(version, batch of each year, scale) of the latest version; version 0 if there is none."""
    try:
        versions = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{path.rstrip('/')}/manifest")
    except AnalysisException:
        return 0, {}, schema.MONEY.scale
    number = versions.agg(F.max("version")).first()[0]
    if number is None:
        return 0, {}, schema.MONEY.scale
    # A row per year, and one without a batch that has the scale even if there are no years.
    rows = versions.filter(F.col("version") == number).collect()
    named = [(row.fiscal_year, row.batch) for row in rows if row.batch is not None]
    if len(rows) != len(dict(named)) + 1:
        raise RuntimeError(f"version {number} of the rollup in {path} was written twice")
    return number, dict(named), rows[0].scale


def _write_batch(amounts: DataFrame, path: str) -> tuple[str, list[int | None]]:
    """Write a batch, one folder per year; its name and its years.

    The rebalance lets AQE give each year as few files as its size asks for, and
    split a year that outgrows one task.
    """
    batch = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/data/batch={batch}"
    fields = schema.rollup(_scale(amounts))
    amounts.select(*fields.names).hint("rebalance", "fiscal_year").write.partitionBy("fiscal_year").parquet(folder)
    written = amounts.sparkSession.read.schema(fields).parquet(folder)
    return batch, [row[0] for row in written.select("fiscal_year").distinct().collect()]


def _replace(spark: SparkSession, path: str, years: list[int | None], amounts: DataFrame) -> None:
    """Publish a version in which the years are those of the amounts. A year without rows is not in it."""
    number, batches, scale = _latest(spark, path)
    if not number:
        raise FileNotFoundError(f"no rollup in {path}")
    if scale != _scale(amounts):
        raise ValueError(f"the rollup has {scale} decimals, the ledger has {_scale(amounts)}")
    batch, found = _write_batch(amounts, path)
    kept = {year: own for year, own in batches.items() if year not in years}
    _publish(spark, path, number + 1, kept | dict.fromkeys(found, batch), scale)


def _publish(spark: SparkSession, path: str, number: int, batches: dict[int | None, str], scale: int) -> None:
    rows = [(None, None, scale), *[(year, batch, scale) for year, batch in batches.items()]]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path.rstrip('/')}/manifest/version={number}")
