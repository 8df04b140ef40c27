"""Helpers shared by the operators: staged tables, runs of sorted batches, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finstat.session import staging_path

# Fixed value: a word is a run of anything but ASCII white space. ``bytes.split()`` cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again.

    This cuts the lineage: an executor lost later costs no second run of what
    lies before. The files stay until the owner of the folder clears it.
    """
    path = staging_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def or_empty(text: str | Column) -> Column:
    """The text, or an empty one for a null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def mark(text_col: str) -> Column:
    """Together with the id, what tells rows apart: rows with one id and one text are one."""
    return F.xxhash64(or_empty(text_col))


def take_rows(docs: DataFrame, takes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``takes`` (id, mark, copies) names, each ``copies`` times.

    ``takes`` has a pair of id and mark once; so repeated rows come out ``copies`` times in all.
    Rows are exchanged once, by the join; the count of repeated ones uses its partitioning.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), mark(text_col).alias("mark"))
    named = takes.select(F.col("id").alias("take_id"), F.col("mark").alias("take_mark"), "copies")
    joined = own.join(named, F.col("id").eqNullSafe(F.col("take_id")) & (F.col("mark") == F.col("take_mark")))
    nth = F.row_number().over(Window.partitionBy("id", "mark").orderBy("copies"))
    first = joined.withColumn("nth", nth).filter("nth = 1 AND copies > 0")
    return first.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which equal keys lie together.

    Holds one key's rows and one batch at a time.
    """
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        cuts = _cuts(table, keys)
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            piece = table.slice(start, end - start)
            if held and _key(held[-1], keys, 0) != _key(piece, keys, 0):
                yield pa.concat_tables(held)
                held = []
            held.append(piece)
    if held:
        yield pa.concat_tables(held)


def _cuts(table: pa.Table, keys: list[str]) -> list[int]:
    changed = np.zeros(table.num_rows - 1, dtype=bool)
    for key in keys:
        values = table.column(key).to_numpy()
        changed |= values[1:] != values[:-1]
    return [0, *(np.flatnonzero(changed) + 1).tolist(), table.num_rows]


def _key(table: pa.Table, keys: list[str], row: int) -> tuple:
    return tuple(table.column(key)[row].as_py() for key in keys)


def merged(batches: Iterable[pa.RecordBatch], least: int = 8192) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``least`` rows: sending many small ones is slow."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def spanning_edges(n: int, pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs among 0..n-1 that join two parts not joined before."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            edges.append((a, b))
    return edges


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (node, component).

    ``component`` is the smallest node of a component and has no row of its own.
    Large-star and small-star rounds, each one written to the shared folder; their
    number grows with the logarithm of the longest path. A hub is reduced to its
    smallest neighbour by a partial aggregate, and its edges are split by AQE.
    Null nodes and loops are no edges.
    """
    stars = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        "edges",
    )
    before = _mark(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        hung = large.join(low, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = staged(hung.unionByName(low.withColumnRenamed("low", "b")).distinct(), "edges")
        after = _mark(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum: equal for equal sets of edges."""
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(mixed, 16)), F.sum(mixed.bitwiseAND(0xFFFF))).first())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
