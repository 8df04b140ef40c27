"""Sorted reports that keep their order in files: numbered rows, and a list of the files with their bounds.

A sorted frame is already cut into ranges, one per task, so it is written as it lies, without another shuffle. Every row gets
an id that rises with the order. The list of files, written last, has one row per file: its number in the
order, the position of its first row, its rows and the bounds of chosen columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = "place"


def save_sorted(report: DataFrame, path: str, bounds: tuple[str, ...] = ()) -> None:
    """Write a sorted frame to a new folder: ``rows`` and, when those are whole, ``files``.

    ``bounds`` names columns whose least and greatest value ``files`` has for each file. Rows that tie on all of
    the report's keys have some order, which is fixed once they are written. A frame that is not sorted keeps the order in which its partitions give their rows.
    """
    spark, base = report.sparkSession, path.rstrip("/")
    taken = {PLACE, "position", "file", "first_place", "first_position"} & set(report.columns)
    if taken:
        raise ValueError(f"the store has columns of its own named {', '.join(sorted(taken))}")
    # The id is that of the partition, then that of the row within it.
    report.withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(f"{base}/rows")
    ends = [f(name).alias(f"{label}_{name}") for name in bounds for label, f in (("least", F.min), ("greatest", F.max))]
    files = (
        spark.read.parquet(f"{base}/rows")
        .groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.min(PLACE).alias("first_place"), F.count(F.lit(1)).alias("n_rows"), *ends)
    )
    # One row per file passes through this window, in one task.
    order = Window.orderBy("first_place")
    before = F.coalesce(F.sum("n_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = files.select(F.row_number().over(order).alias("number"), (before + 1).alias("first_position"), *files.columns)
    numbered.coalesce(1).write.parquet(f"{base}/files")


def sorted_files(spark: SparkSession, path: str) -> DataFrame:
    """The list of files; by ``number`` they are in the order of the report."""
    return spark.read.parquet(f"{path.rstrip('/')}/files")


def load_sorted(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """What ``save_sorted`` wrote, with the ``position`` of each row, from 1: all of it, or the rows from first to last.

    A range of positions reads only the files that hold some of it. The rows come in no promised order: sort by ``position`` where it matters.
    """
    files, rows = sorted_files(spark, path), spark.read.parquet(f"{path.rstrip('/')}/rows")
    columns = [c for c in rows.columns if c != PLACE]
    if first is not None or last is not None:
        held = _between(F.col("first_position") + F.col("n_rows") - 1, first, None) & _between(F.col("first_position"), None, last)
        # As many names as files are read, which the driver lists for any scan.
        paths = [f"{path.rstrip('/')}/rows/{row.file}" for row in files.filter(held).select("file").collect()]
        rows = spark.read.schema(rows.schema).parquet(*paths) if paths else rows.filter(F.lit(False))
    placed = rows.withColumn("file", F.col("_metadata.file_name"))
    position = F.col("first_position") + F.col(PLACE) - F.col("first_place")
    found = placed.join(files.select("file", "first_place", "first_position"), "file").select(position.alias("position"), *columns)
    return found.filter(_between(F.col("position"), first, last))


def _between(column: Column, first: int | None, last: int | None) -> Column:
    low = F.lit(True) if first is None else column >= first
    return low if last is None else low & (column <= last)
