"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstat.llm.common import WORD, mark, or_empty, staged, take_rows


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that only the id and the seed decide: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(rows: DataFrame, weights: Sequence[float], max_copies: int) -> DataFrame:
    """Per source: source_size and target; ``rows`` has source and size.

    Sources in code-point order, null last, take the weights in turn. They share
    the sum of all sizes by weight; no target exceeds ``max_copies`` times its
    source, and the excess goes to the others by weight. Filling the sources from
    the smallest size per weight up, the share per unit of weight is the largest of
    (what is left) / (weight that is left). One row per source is sorted in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    fill = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - max_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shares = sizes.withColumn("share", left.cast("double") / weight_left)
    target = F.least(F.col("source_size").cast("double") * max_copies, F.max("share").over(everything) * F.col("weight"))
    return shares.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    max_copies: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
) -> DataFrame:
    """One row per document: id, mark (a hash of the text), source, size, source_size, target, copies, taken.

    Each document of a source is taken as many whole times as the target holds the
    source; what is left of the target is an unequal-probability sample over the
    corpus: with f the part of a source that is left, a document's rank is its random
    odds u / (1 - u) over its inclusion odds f / (1 - f), and documents are taken in
    rank order up to the size that is left, the last one if more than half of it fits.
    So a source's taken size is within half a document of its target.

    The running sums that this needs are taken in two levels: ranks fall into about
    sqrt(rows) bins of equal probability, sums run within bins, and totals run over
    bins. No task holds a source, however large.

    - Size is the number of words; a null text has none. Null is a source of its own.
    - A null id draws as one id. Rows repeated with one id draw the same number and are
      taken one after the other.
    - An empty table gives no rows. Other columns are not read, whatever their names.
    """
    rows = staged(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.regexp_count(or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
            uniform(F.col(id_col), seed).alias("u"),
            mark(text_col).alias("mark"),
        ),
        "sizes",
    )
    bins = math.isqrt(rows.count()) + 1
    targets = staged(source_targets(rows, weights, max_copies), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) - F.col("whole")
    plans = (
        targets.withColumn("whole", whole)
        .withColumn("share", share)
        .withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
    )
    odds = F.col("u") / (1 - F.col("u"))
    ranked = (
        rows.join(plans, rows["source"].eqNullSafe(plans["source"]))
        .drop(plans["source"])
        .withColumn("rank", F.when(F.col("share") > 0, odds * (1 - F.col("share")) / F.col("share")).otherwise(odds))
        .withColumn("bin", F.floor(F.col("u") * bins).cast("int"))
    )
    sums = rows.groupBy("source", F.floor(F.col("u") * bins).cast("int").alias("bin")).agg(F.sum("size").alias("sum"))
    over_bins = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("bin_source"),
        F.col("bin").alias("bin_no"),
        F.coalesce(F.sum("sum").over(over_bins), F.lit(0)).alias("start"),
    )
    in_bin = Window.partitionBy("source", "bin").orderBy("rank", "u", "id", "size")
    before = F.coalesce(F.sum("size").over(in_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranked.withColumn("before", before).join(
        starts, F.col("source").eqNullSafe(F.col("bin_source")) & (F.col("bin") == F.col("bin_no"))
    )
    middle = (F.col("start") + F.col("before")).cast("double") + F.col("size") / F.lit(2.0)
    copies = F.col("whole") + F.when(middle <= F.col("rest"), 1).otherwise(0)
    return placed.withColumn("copies", copies).select(
        "id", "mark", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_copies: int = 3, **columns) -> DataFrame:
    """The rows of the mix with all their columns, each as often as it is taken."""
    mix = mix_sources(docs, weights, max_copies, **columns)
    takes = mix.groupBy("id", "mark").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    return take_rows(docs, takes, columns.get("id_col", "doc_id"), columns.get("text_col", "text"))


SQL = r"""
WITH rows AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|0'), 1, 13))::BIGINT::DOUBLE + 0.5)
             / 4503599627370496.0::DOUBLE AS u
  FROM documents
), sized AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM rows GROUP BY source
), shares AS (
  SELECT *,
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER fill, 0))::DOUBLE
             / (sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0.0)) AS share
  FROM sized
  WINDOW fill AS (ORDER BY source_size / weight, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(source_size::DOUBLE * 3, max(share) OVER () * weight) AS target FROM shares
), plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets
), placed AS (
  SELECT r.doc_id, r.size, p.source_size, p.target, p.whole,
         p.target - (p.whole * p.source_size)::DOUBLE AS rest,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.u, r.doc_id, r.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN plans p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN before::DOUBLE + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""


def op9(documents: DataFrame) -> DataFrame:
    mixed = mix_sources(documents, weights=(1, 2, 3), max_copies=3)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
