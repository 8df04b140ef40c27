"""The operators as registered queries over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finstat.llm import exact, filter_audit, histogram, lattice, licenses, mixing, nbsvm, pieces, repair, simhash, toxicity, warc, windows
from finstat.llm.common import read_table


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, table))


def _with_labels(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_warc": _over("pages", warc.op1),
    "op2_embedding_dedup": _over("embeddings", lattice.op2),
    "op3_simhash": _over("documents", simhash.op3),
    "op4_sharding": _over("documents", histogram.op4),
    "op5_license_scan": _over("documents", licenses.op5),
    "op6_toxicity": _with_labels(toxicity.op6),
    "op7_substring_dedup": _over("documents", windows.op7),
    "op8_sentencepiece": _over("documents", pieces.op8),
    "op9_mixing": _over("documents", mixing.op9),
    "op10_exact_dedup": _over("documents", exact.op10),
    "op11_filter_audit": _with_labels(filter_audit.op11),
    "op12_quality": _with_labels(nbsvm.op12),
    "op13_repair": _over("conversations", repair.op13),
}

SQL = {
    "op1_warc": warc.SQL,
    "op2_embedding_dedup": lattice.SQL,
    "op5_license_scan": licenses.SQL,
    "op9_mixing": mixing.SQL,
    "op10_exact_dedup": exact.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_repair": repair.SQL,
}
