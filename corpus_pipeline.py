"""A corpus pipeline of the operators in finstat.llm: from documents to token ids.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as Parquet and
read again as the next one's docs. All but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finstat.llm import exact, mixing, pieces, simhash, toxicity
from finstat.llm.common import read_table, staged


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored words are those of toxic ones go."""
    return toxicity.clean_documents(docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact.exact_dedup(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of three-word shingles within three bits, the one with the smallest doc_id stays."""
    return simhash.simhash_dedup(docs, words=3, radius=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn; a document comes as often as the mix takes it, three times at most."""
    return mixing.mixed_rows(docs, weights=(1, 2, 3), max_copies=3)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids with an end id, the bytes each piece stands for, and the text decoded from the ids."""
    return pieces.encode_pieces(docs, pieces.default_model()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("source mixing", mix),
    ("sentencepiece", tokens),
]

# SQL cannot express the toxicity model, fingerprints or pieces; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
