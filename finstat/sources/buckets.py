"""The ledger as bucketed tables of the catalog: lines meet their entries without a shuffle, hot entries included.

Spark's adaptive joins cannot split a bucket, so one entry with a large share of the lines would make one slow task. Here
the lines of such an entry are dealt over salts when they are written, and its row of the entries is copied once for each
salt. Lines and entries are bucketed on (entry, salt) and joined on both, so every line still meets exactly one
row of its entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstat import schema
from finstat.functions.predicates import posted
from finstat.sources.ledger import POSTED_ACCOUNTS, TABLES, YEAR_COLUMN, Ledger, unsalted

SALT_COLUMN = "salt"
HOT_ENTRIES = "hot_journal_entry"
# No salt of an entry holds more than this part of an average bucket of its year.
PARTS = 16


def save_buckets(book: Ledger, database: str, buckets: int) -> None:
    """Write a ledger to the tables of an existing database, lines and entries in so many buckets.

    Lines also lie in one folder per year of their entry, so a one-year report reads that year, without a shuffle of lines.
    An entry with more than 1/(16 * buckets) of the lines of its year is hot. Its lines are dealt by a hash
    of their columns and of the partition they come from, so lines that repeat part ways, too. Lines without an
    entry count as the lines of one entry.

    Writing shuffles the lines once, and their counts per entry. At most ``16 * buckets`` entries of a year can be hot; they are kept as the table
    ``hot_journal_entry`` and broadcast. Whoever adds lines by other means gives them salt 0, or any salt
    that the entry has.
    """
    spark, book, key = book.lines.sparkSession, unsalted(book), "journal_entry_id"
    dated = book.entries.select(key, F.year("entry_date").alias(YEAR_COLUMN))
    counts = book.lines.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(dated, key, "left")
    # One row per year.
    totals = F.broadcast(counts.groupBy(F.col(YEAR_COLUMN).alias("of_year")).agg(F.sum("n").alias("total")))
    parts = F.ceil(F.col("n") * (PARTS * buckets) / F.col("total")).cast("int")
    shares = counts.join(totals, F.col(YEAR_COLUMN).eqNullSafe(F.col("of_year"))).select(key, parts.alias("salts"))
    shares.filter("salts > 1").write.saveAsTable(f"{database}.{HOT_ENTRIES}")
    hot = spark.table(f"{database}.{HOT_ENTRIES}").withColumnRenamed(key, "hot_id")

    names = [field.name for field in schema.LINES]
    dealt = F.pmod(F.xxhash64(*names, F.spark_partition_id()), F.coalesce("salts", F.lit(1))).cast("int")
    lines = book.lines.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("hot_id")), "left").select(*names, dealt.alias(SALT_COLUMN))
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias(SALT_COLUMN)
    entries = book.entries.join(F.broadcast(hot), F.col(key) == F.col("hot_id"), "left").select(*book.entries.columns, salts)
    entries = entries.repartition(buckets, key, SALT_COLUMN)
    years = entries.select(key, SALT_COLUMN, F.year("entry_date").alias(YEAR_COLUMN))
    lines = lines.repartition(buckets, key, SALT_COLUMN).join(years, [key, SALT_COLUMN], "left").select(*names, SALT_COLUMN, YEAR_COLUMN)

    for role, (table, _) in TABLES.items():
        if role == "lines":
            writer = _bucketed(lines, buckets).partitionBy(YEAR_COLUMN)
        elif role == "entries":
            writer = _bucketed(entries, buckets)
        else:
            writer = getattr(book, role).write
        writer.saveAsTable(f"{database}.{table}")
    save_posted_accounts(spark, database)


def _bucketed(frame: DataFrame, buckets: int):
    keys = ("journal_entry_id", SALT_COLUMN)
    return frame.write.bucketBy(buckets, *keys).sortBy(*keys)


def save_posted_accounts(spark: SparkSession, database: str) -> None:
    """Write the ids of the accounts with lines that count, as ``save_ledger`` does beside its files."""
    stored = _read(spark, database)
    kept = stored["entries"].filter(posted()).select("journal_entry_id", SALT_COLUMN)
    found = stored["lines"].join(kept, ["journal_entry_id", SALT_COLUMN]).select("account_id").filter("account_id IS NOT NULL")
    found.distinct().orderBy("account_id").write.mode("overwrite").saveAsTable(f"{database}.{POSTED_ACCOUNTS}")


def _read(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    return {role: spark.table(f"{database}.{table}") for role, (table, _) in TABLES.items()}


def load_buckets(spark: SparkSession, database: str, exact_names: bool = False) -> Ledger:
    """Read what ``save_buckets`` wrote. ``entries`` holds copies of hot entries; ``unsalted`` gives the plain tables."""
    return Ledger(
        **_read(spark, database),
        exact_names=exact_names,
        year_column=YEAR_COLUMN,
        posted_accounts=spark.table(f"{database}.{POSTED_ACCOUNTS}"),
        salt_column=SALT_COLUMN,
    )
