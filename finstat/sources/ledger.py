"""The ledger: four DataFrames, and the ways to read them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finstat import schema
from finstat.functions.predicates import posted

# The table names a ledger database uses.
TABLES = {
    "lines": ("journal_entry_line_item", schema.LINES),
    "entries": ("journal_entry", schema.ENTRIES),
    "accounts": ("account", schema.ACCOUNTS),
    "sections": ("statement_section", schema.SECTIONS),
}

MONEY_COLUMNS = ("debit", "credit")
# The column of stored lines that holds the year of their entry.
YEAR_COLUMN = "entry_year"
# The table of accounts with lines that count, beside a stored ledger.
POSTED_ACCOUNTS = "posted_account"


@dataclass(frozen=True)
class Ledger:
    """Lines are the fact; the other three are its header and dimensions.

    ``exact_names``: section names match and group as they are spelled. By default case and trailing
    blanks make no difference, as under the padded, case-blind collations of ledger databases.
    ``year_column``: a column of the lines that holds the year of their entry (see ``load_ledger``).
    ``posted_accounts``: the ids of the accounts that have lines that count, in any year (see ``save_ledger``).
    ``salt_column``: lines meet entries on this column, too (see ``buckets.save_buckets``).
    """

    lines: DataFrame
    entries: DataFrame
    accounts: DataFrame
    sections: DataFrame
    exact_names: bool = False
    year_column: str | None = None
    posted_accounts: DataFrame | None = None
    salt_column: str | None = None


def unsalted(book: Ledger) -> Ledger:
    """The ledger with one row for each entry, whatever its layout."""
    if book.salt_column is None:
        return book
    entries = book.entries.filter(F.col(book.salt_column) == 0).drop(book.salt_column)
    return replace(book, lines=book.lines.drop(book.salt_column), entries=entries, salt_column=None)


def money_type(*sources: T.DataType) -> T.DecimalType:
    """One exact type for the sides of a line: decimals keep their scale, all else is FLOAT_MONEY.

    Decimals of more than MAX_DIGITS digits are held in that many; an amount that needs them all raises.
    """
    types = [t if isinstance(t, T.DecimalType) else schema.FLOAT_MONEY for t in sources if t != T.NullType()]
    types = types or [schema.MONEY]
    scale, digits = max(t.scale for t in types), max(t.precision - t.scale for t in types)
    if scale > schema.MAX_SCALE:
        raise ValueError(f"amounts of {', '.join(t.simpleString() for t in types)} are beyond {schema.MAX_SCALE} decimals")
    return T.DecimalType(min(scale + digits, schema.MAX_DIGITS), scale)


def exact_money(frame: DataFrame, name: str, target: T.DecimalType) -> Column:
    """An amount in an exact type; one that does not fit raises, whatever the session's ANSI mode.

    A NULL side is data, so nothing but a NULL may become one.
    """
    source = F.col(name)
    if frame.schema[name].dataType in (target, T.NullType()):
        return source.cast(target)
    fitted = source.try_cast(target)
    message = F.concat(F.lit(f"{name} is no amount of {target.simpleString()}: "), source.cast("string"))
    return F.when(source.isNotNull() & fitted.isNull(), F.raise_error(message)).otherwise(fitted)


def conform(frame: DataFrame, fields: T.StructType) -> DataFrame:
    """Select the schema's columns in the schema's types, amounts in one type that holds them exactly.

    A cast to a column's own type is a no-op for Catalyst, so filters on
    conformed columns still reach the scan. ``description`` is carried by no
    report, so a source without it is accepted.
    """
    columns = []
    for field in fields:
        if field.name in MONEY_COLUMNS:
            column = exact_money(frame, field.name, money_type(*(frame.schema[c].dataType for c in MONEY_COLUMNS)))
        elif field.name == "description" and field.name not in frame.columns:
            column = F.lit(None).cast(field.dataType)
        else:
            column = F.col(field.name).cast(field.dataType)
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def ledger(
    lines: DataFrame, entries: DataFrame, accounts: DataFrame, sections: DataFrame, exact_names: bool = False
) -> Ledger:
    """A ledger over any four frames that carry the schema's columns."""
    return Ledger(
        conform(lines, schema.LINES),
        conform(entries, schema.ENTRIES),
        conform(accounts, schema.ACCOUNTS),
        conform(sections, schema.SECTIONS),
        exact_names,
    )


def from_parquet(spark: SparkSession, folder: str) -> Ledger:
    """Read ``<folder>/<table name>`` for each of the four tables."""
    return from_files(spark, folder, "parquet")


def from_files(spark: SparkSession, folder: str, source: str, **options) -> Ledger:
    """Read the four tables with any of Spark's file sources (orc, json, csv ...).

    CSV and JSON get the schema: inferring it would read the fact twice. Amounts
    are read as text there and turned into FLOAT_MONEY, so that none is rounded unseen.
    """
    frames = {}
    for role, (table, fields) in TABLES.items():
        reader = spark.read.format(source).options(**options)
        if source in ("csv", "json"):
            text = {name: T.StructField(name, T.StringType()) for name in MONEY_COLUMNS}
            reader = reader.schema(T.StructType([text.get(field.name, field) for field in fields]))
        frames[role] = reader.load(f"{folder.rstrip('/')}/{table}")
    return ledger(**frames)


def from_tables(spark: SparkSession, database: str | None = None) -> Ledger:
    """Read the four tables from the session catalog."""
    prefix = f"{database}." if database else ""
    return ledger(**{role: spark.table(prefix + table) for role, (table, _) in TABLES.items()})


def save_ledger(book: Ledger, folder: str) -> None:
    """Write a ledger as Parquet with the year of its entry on each line, one folder of lines per year.

    A report of one year then reads the lines of that year only. Lines without an entry or
    a date have no year, as in every report. A year is split over tasks by its size.

    The two-year reports list what has lines in any year. The accounts that do are stored beside the ledger: one id for
    each, at most as many as there are accounts. So these reports read two years, not all. Whoever adds
    lines to the folder by other means also rewrites that table (``save_posted_accounts``).
    """
    book = unsalted(book)
    year = F.year("entry_date").alias(YEAR_COLUMN)
    dated = book.lines.drop(YEAR_COLUMN).join(book.entries.select("journal_entry_id", year), "journal_entry_id", "left")
    for role, (table, _) in TABLES.items():
        path = f"{folder.rstrip('/')}/{table}"
        if role == "lines":
            dated.hint("rebalance", YEAR_COLUMN).write.partitionBy(YEAR_COLUMN).parquet(path)
        else:
            getattr(book, role).write.parquet(path)
    save_posted_accounts(book.lines.sparkSession, folder)


def save_posted_accounts(spark: SparkSession, folder: str) -> None:
    """Write the ids of the accounts with lines that count, from the lines as they are stored.

    Two columns of the lines and the flags of the entries are read. Ids are sorted, so that they pack well.
    """
    stored = _read(spark, folder)
    kept = stored["entries"].filter(posted()).select("journal_entry_id")
    ids = stored["lines"].join(kept, "journal_entry_id").select("account_id").filter("account_id IS NOT NULL").distinct()
    ids.orderBy("account_id").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{POSTED_ACCOUNTS}")


def _read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {role: spark.read.parquet(f"{folder.rstrip('/')}/{table}") for role, (table, _) in TABLES.items()}


def load_ledger(spark: SparkSession, folder: str, exact_names: bool = False) -> Ledger:
    """Read what ``save_ledger`` wrote. Without the table of posted accounts, two-year reports read all years."""
    try:
        accounts = spark.read.schema("account_id long").parquet(f"{folder.rstrip('/')}/{POSTED_ACCOUNTS}")
    except AnalysisException:
        accounts = None
    return Ledger(**_read(spark, folder), exact_names=exact_names, year_column=YEAR_COLUMN, posted_accounts=accounts)


def register_views(book: Ledger) -> None:
    """Make the ledger queryable with ``spark.sql`` under its table names."""
    book = unsalted(book)
    for role, (table, _) in TABLES.items():
        getattr(book, role).createOrReplaceTempView(table)
