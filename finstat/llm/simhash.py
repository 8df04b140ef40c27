"""SimHash near-dedup: fingerprints in Python, BK-trees over shards of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstat.llm.common import components, mark, merged, or_empty, sorted_runs, spanning_edges, staged, take_rows

BITS = 64
PIECE = 200_000  # shingles hashed at a time, which bounds the memory of a long text


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit number."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - width + 1], ends[width - 1 :]
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), PIECE):
        spans = zip(starts[at : at + PIECE].tolist(), ends[at : at + PIECE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """One row (id, mark, fp) per document."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text.as_py(), words) for text in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "fp"])

    text = or_empty(text_col).cast("binary").alias("text")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), mark(text_col).alias("mark"), text)
    return texts.mapInArrow(hashed, "id long, mark long, fp long")


class BKTree:
    """Fingerprints as nodes; a child's edge is its Hamming distance to its parent."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.edges: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Nodes within the radius. By the triangle inequality only edges within it need following."""
        stack = [0] if self.nodes else []
        nodes, edges = self.nodes, self.edges
        while stack:
            at = stack.pop()
            distance = (nodes[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            low, high = distance - radius, distance + radius
            stack.extend(child for edge, child in edges[at].items() if low <= edge <= high)

    def add(self, value: int) -> None:
        at, new = 0, len(self.nodes)
        self.nodes.append(value)
        self.edges.append({})
        while new:
            distance = (self.nodes[at] ^ value).bit_count()
            child = self.edges[at].setdefault(distance, new)
            if child == new:
                break
            at = child


    def grow(self, values: list[int], radius: int) -> Iterator[tuple[int, int]]:
        """Add the values, and give each one's links (number, number) to those before it."""
        for number, value in enumerate(values):
            yield from ((found, number) for found in self.near(value, radius))
            self.add(value)


def _split(rows: DataFrame, width: int, radius: int) -> tuple[DataFrame, int]:
    """Deal rows (shard, rest, fp, rep) to finer shards, by each of radius + 1 blocks of the rest.

    Two numbers that differ in at most ``radius`` bits agree in a whole block, so
    every link still has a shard that holds both ends.
    """
    blocks = radius + 1
    bounds = [width * i // blocks for i in range(blocks + 1)]
    parts, widest = [], 0
    for number, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        rest = F.col("rest")
        value = F.shiftrightunsigned(rest, low).bitwiseAND((1 << (high - low)) - 1)
        above = F.shiftleft(F.shiftrightunsigned(rest, high), low) if high < BITS else F.lit(0).cast("long")
        below = rest.bitwiseAND((1 << low) - 1)
        parts.append(
            F.struct(F.xxhash64("shard", F.lit(number), value).alias("shard"), above.bitwiseOR(below).alias("rest"))
        )
        widest = max(widest, width - (high - low))
    dealt = rows.select(F.explode(F.array(*parts)).alias("part"), "fp", "rep")
    return dealt.select("part.shard", "part.rest", "fp", "rep"), widest


def _links(rows: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect what lies within the radius inside each shard."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, ["shard"]):
            if run.num_rows < 2:
                continue
            prints = run.column("fp").to_numpy().view(np.uint64).tolist()
            tree = BKTree()
            if edges := spanning_edges(len(prints), tree.grow(prints, radius)):
                reps = run.column("rep").to_numpy()
                a, b = (reps[list(side)] for side in zip(*edges, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    placed = rows.select("shard", "fp", "rep").repartition("shard").sortWithinPartitions("shard")
    return placed.mapInArrow(lambda batches: merged(search(batches)), "a long, b long")


def link_prints(prints: DataFrame, radius: int = 3, shard_rows: int = 1024) -> DataFrame:
    """(node, component) of distinct fingerprints (fp, rep) linked within ``radius`` bits.

    Fingerprints are dealt to shards by the blocks of their bits; each shard's
    BK-tree is built, and searched by its members, in the task the shard is sent to.
    A shard of more than ``shard_rows`` is dealt on by blocks of its remaining bits, which
    loses no link, until the bits that are left bound it.
    """
    rows = prints.select(F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest"), "fp", "rep")
    rows, width = _split(rows, BITS, radius)
    found = []
    while True:
        large = rows.groupBy("shard").count().filter(F.col("count") > shard_rows).select("shard")
        if (1 << width) <= 16 * shard_rows or large.isEmpty():
            found.append(staged(_links(rows, radius), "links"))
            break
        found.append(staged(_links(rows.join(large, "shard", "left_anti"), radius), "links"))
        rows, width = _split(rows.join(large, "shard", "left_semi"), width, radius)
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return components(edges)


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = 3,
    shard_rows: int = 1024,
) -> DataFrame:
    """One row per document: id, mark (a hash of the text), fp, component_id (the smallest id reachable by links).

    Copies share a fingerprint and are reduced to their smallest id before anything
    is linked, so a group of copies costs one node.

    - Null and blank texts have fingerprint 0 and link like any other.
    - Rows with a null id get the component of their fingerprint, and null if no row there has an id.
    - Repeated rows each keep their row. An empty table gives no rows.
    - Other columns are not read, whatever their names. Text of any length is read whole.
    """
    prints = staged(fingerprints(docs, id_col, text_col, words), "prints")
    reps = staged(prints.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    nodes = link_prints(reps.filter("rep IS NOT NULL"), radius, shard_rows)
    classes = reps.join(nodes, reps["rep"] == nodes["node"], "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(classes, F.col("fp") == F.col("class_fp")).select("id", "mark", "fp", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id.

    Of rows that share this id, the one whose text has the smallest hash; without any id, one row per fingerprint.
    """
    linked = simhash_components(docs, id_col, text_col, words, radius).filter("component_id IS NULL OR id = component_id")
    one = F.when(F.col("component_id").isNull(), F.col("fp"))
    kept = linked.groupBy("component_id", one.alias("fp")).agg(F.min("mark").alias("mark"))
    takes = kept.select(F.col("component_id").alias("id"), "mark", F.lit(1).alias("copies")).distinct()
    return take_rows(docs, takes, id_col, text_col)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op3(documents: DataFrame) -> DataFrame:
    linked = simhash_components(documents, words=3, radius=3)
    return linked.select(F.col("id").alias("doc_id"), as_hex(F.col("fp")).alias("fingerprint"), "component_id")
