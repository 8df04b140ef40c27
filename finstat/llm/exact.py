"""Exact dedup: a tree merge of sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstat.llm.common import or_empty, staged, take_rows

DIGEST = ["sha", "n_bytes", "check"]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest of its whole text, and the run it starts in.

    The digest is the SHA-256 with the byte length and an independent 64-bit hash,
    all of which must agree for two texts to count as equal at any level.
    """
    text = or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.sha2(text, 256).alias("sha"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
        F.spark_partition_id().alias("run"),
    )


def merge_runs(runs: DataFrame, keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """Merge the runs ``fan_in`` at a time until one is left: digest, keep_id, group_size.

    Each round exchanges only digests, not texts. Copies are combined before every
    exchange, so a group as large as a third of all rows sends one row per run. The
    rows of a round are dealt by run and digest, so a round uses the whole cluster,
    the last one too. Each round's runs are written sorted to the shared folder.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    left = (runs.agg(F.max("run")).first()[0] or 0) + 1
    merged = runs.withColumnsRenamed({"id": "keep_id"}).withColumn("group_size", F.lit(1).cast("long"))
    while True:
        left = -(-left // fan_in)
        merged = (
            merged.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), *DIGEST)
            .agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
            .sortWithinPartitions("run", *DIGEST)
        )
        if left == 1:
            return staged(merged.drop("run"), "runs")
        merged = staged(merged, "runs")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 16
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, mark (a hash of the text).

    Of equal whole texts the row with the smallest (or largest) id is kept.
    - A null text counts as empty.
    - A null id is kept only if no row of its group has an id.
    - Of rows repeated with the same id and text, one is kept; each has its row.
    - An empty table gives no rows. Other columns are not read, whatever their names.
    """
    runs = staged(digest_runs(docs, id_col, text_col), "digests")
    groups = merge_runs(runs, keep, fan_in)
    rows = runs.groupBy("id", *DIGEST).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(groups, DIGEST).select(
        F.col("id"),
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"),
        F.col("sha").alias("text_sha256"),
        F.col("check").alias("mark"),
    ).select(
        "id",
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
        "mark",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that ``exact_groups`` keeps, with all their columns."""
    kept = exact_groups(docs, id_col, text_col, keep).filter("kept").select("id", "mark", F.lit(1).alias("copies"))
    return take_rows(docs, kept, id_col, text_col)


SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g
           AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op10(documents: DataFrame) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_groups(documents, keep="largest").drop("mark").withColumnRenamed("id", "doc_id")
