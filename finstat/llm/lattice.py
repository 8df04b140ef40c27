"""Embedding near-dedup: vectors hashed to E8 lattice points, neighbouring cells probed, cosine verified."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstat.llm.common import components, merged, sorted_runs, spanning_edges, staged

DIM = 8


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to a cell's neighbours."""
    found = []
    for i, j in itertools.combinations(range(DIM), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            vector = np.zeros(DIM)
            vector[i], vector[j] = s, t
            found.append(vector)
    for signs in itertools.product((0.5, -0.5), repeat=DIM):
        if sum(s < 0 for s in signs) % 2 == 0:
            found.append(np.array(signs))
    return np.array(found)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    point = np.rint(x)
    error = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(error[odd]).argmax(axis=1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: E8 is D8 and D8 moved by a half in every direction."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


class Hasher:
    """``tables`` random projections to eight dimensions; a vector's cell and ``probes`` neighbours in each."""

    def __init__(self, dim: int, tables: int, probes: int, cell: float, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.maps = rng.normal(size=(tables, dim, DIM)) / np.sqrt(DIM) / cell
        self.shifts = rng.uniform(0, 2, size=(tables, DIM))
        self.mix = rng.integers(-(1 << 62), 1 << 62, size=(tables, DIM + 2), dtype=np.int64) | 1
        self.planes = rng.normal(size=(dim, 64))
        self.roots, self.probes, self.dim = roots(), probes, dim

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """On which side of 64 random planes a vector lies, as the bits of a number."""
        return np.packbits(unit @ self.planes > 0, axis=1).view(np.int64).ravel()

    def keys(self, unit: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """For each vector and table the keys of its own cell and of the probed ones: n x tables x (1 + probes)."""
        out = []
        for projection, shift, mix in zip(self.maps, self.shifts, self.mix, strict=True):
            x = unit @ projection + shift
            point = nearest_e8(x)
            order = np.argsort(-((x - point) @ self.roots.T), axis=1, kind="stable")[:, : self.probes]
            cells = np.concatenate((point[:, None], point[:, None] + self.roots[order]), axis=1)
            doubled = np.rint(cells * 2).astype(np.int64)
            key = (doubled * mix[:DIM]).sum(axis=2) + labels[:, None] * mix[DIM] + np.array([self.dim]) * mix[DIM + 1]
            out.append((key ^ (key >> 31)) * mix[0])
        return np.stack(out, axis=1)


def _usable(vector: list | None) -> bool:
    if not vector or None in vector:
        return False
    values = np.asarray(vector, dtype=np.float64)
    return bool(np.isfinite(values).all() and values.any())


def _hashed(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, settings: tuple) -> DataFrame:
    """(id, digest, label, vec, keys, sketch) of the vectors that can link; (id, null ...) of the others."""
    names = ["id", "digest", "label", "vec", "keys", "sketch"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            ids, labels, rows = (c.to_pylist() for c in batch.columns)
            digest, vec, keys, sketch = ([None] * len(ids) for _ in range(4))
            good = [i for i in range(len(ids)) if ids[i] is not None and labels[i] is not None and _usable(rows[i])]
            for dim, group in itertools.groupby(sorted(good, key=lambda i: len(rows[i])), key=lambda i: len(rows[i])):
                group = list(group)
                if dim not in hashers:
                    hashers[dim] = Hasher(dim, *settings)
                values = np.array([rows[i] for i in group], dtype=np.float64)
                scaled = values / np.abs(values).max(axis=1, keepdims=True)
                unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                found = hashers[dim].keys(unit, np.array([labels[i] for i in group], dtype=np.int64))
                sides = hashers[dim].sketch(unit).tolist()
                for i, value, key, side in zip(group, values, found, sides, strict=True):
                    mark = hashlib.blake2b(value.tobytes(), digest_size=16, key=str(labels[i]).encode())
                    digest[i], vec[i], keys[i], sketch[i] = mark.digest(), rows[i], key.ravel(), side
            types = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.int64())
            columns = [pa.array(c, t) for c, t in zip((ids, digest, labels, vec, keys, sketch), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"),
    )
    return rows.mapInArrow(run, "id long, digest binary, label long, vec array<double>, keys array<long>, sketch long")


def _screen(rows: DataFrame, cosine: float) -> DataFrame:
    """The members of a block that have another one whose sketch is as near as a link's may be.

    At the angle of the least cosine a bit differs with probability angle / pi; the bound lies six
    standard deviations above the mean, so it loses no link that the tables find but one in millions.
    """
    odds = np.arccos(cosine) / np.pi
    most = int(64 * odds + 6 * np.sqrt(64 * odds * (1 - odds)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sorted_runs(batches, ["key", "low", "high"]):
            if block.num_rows < 2:
                continue
            sketch, chunk = block.column("sketch").to_numpy(), block.column("chunk").to_numpy()
            low, high = block.column("low")[0].as_py(), block.column("high")[0].as_py()
            left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
            near = np.bitwise_count((sketch[left][:, None] ^ sketch[right][None]).view(np.uint64)) <= most
            if low == high:
                np.fill_diagonal(near, False)
            kept = np.union1d(left[near.any(axis=1)], right[near.any(axis=0)])
            if len(kept):
                yield from block.drop_columns(["sketch"]).take(pa.array(kept)).combine_chunks().to_batches()

    placed = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return placed.mapInArrow(lambda batches: merged(run(batches)), "digest binary, key long, place int, chunk int, low int, high int")


def _met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair meets in a's own cell, and in b's own cell; a, b: pairs x (1 + probes) keys of one table."""
    return (a[:, :1] == b).any(axis=1), (a == b[:, :1]).any(axis=1)


def _first_meeting(a: np.ndarray, b: np.ndarray, table: int, key: int) -> np.ndarray:
    """Of pairs found under a key, those that meet under no earlier table and no smaller key of this one."""
    first = np.ones(len(a), dtype=bool)
    for earlier in range(table):
        in_a, in_b = _met(a[:, earlier], b[:, earlier])
        first &= ~(in_a | in_b)
    in_a, in_b = _met(a[:, table], b[:, table])
    own_a, own_b = a[:, table, 0], b[:, table, 0]
    here = ((own_a == key) & in_a) | ((own_b == key) & in_b)
    smaller = (in_a & (own_a < key)) | (in_b & (own_b < key))
    return first & here & ~smaller


def _lists(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    return pc.list_flatten(column).to_numpy().reshape(rows, -1)


def _verify(rows: DataFrame, cosine: float, width: int) -> DataFrame:
    """Links inside blocks: (digest, links) to add up, and edges (a, b) that connect what is linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sorted_runs(batches, ["key", "low", "high"]):
            if block.num_rows < 2:
                continue
            key, low, high = (block.column(c)[0].as_py() for c in ("key", "low", "high"))
            table = block.column("place")[0].as_py() // width
            chunk, label = block.column("chunk").to_numpy(), block.column("label").to_numpy()
            dims = np.asarray(pc.list_value_length(block.column("vec")))
            keys = _lists(block.column("keys"), block.num_rows).reshape(block.num_rows, -1, width)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                left, right = (at, at) if low == high else (at[chunk[at] == low], at[chunk[at] == high])
                if not len(left) or not len(right):
                    continue
                vec = np.zeros((block.num_rows, dim))
                vec[at] = _lists(block.column("vec").take(pa.array(at)), len(at))
                vec[at] /= np.abs(vec[at]).max(axis=1, keepdims=True)
                norm = np.linalg.norm(vec, axis=1)
                close = (vec[left] @ vec[right].T) / np.outer(norm[left], norm[right]) >= cosine
                i, j = np.nonzero(close)
                i, j = left[i], right[j]
                keep = (label[i] == label[j]) & ((i < j) if low == high else True)
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                new = np.concatenate(
                    [
                        _first_meeting(keys[i[s : s + 65536]], keys[j[s : s + 65536]], table, key)
                        for s in range(0, len(i), 65536)
                    ]
                )
                i, j = i[new], j[new]
                if not len(i):
                    continue
                copies = block.column("n").to_numpy()
                links = np.bincount(i, copies[j], block.num_rows) + np.bincount(j, copies[i], block.num_rows)
                linked = np.flatnonzero(links)
                edges = spanning_edges(block.num_rows, zip(i.tolist(), j.tolist(), strict=True))
                reps = block.column("rep").to_numpy()
                a, b = (reps[list(side)] for side in zip(*edges, strict=True))
                nothing = pa.nulls(len(edges), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([block.column("digest").combine_chunks().take(pa.array(linked)).cast(pa.binary()), nothing]),
                        pa.array(np.concatenate((links[linked], np.zeros(len(edges)))).astype(np.int64)),
                        pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(a)]),
                        pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(b)]),
                    ],
                    names=["digest", "links", "a", "b"],
                )

    placed = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return placed.mapInArrow(lambda batches: merged(run(batches)), "digest binary, links long, a long, b long")


def lattice_components(
    vectors: DataFrame,
    cosine: float = 0.93,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    tables: int = 6,
    probes: int = 4,
    cell: float = 0.5,
    block_rows: int = 512,
    seed: int = 0,
) -> DataFrame:
    """One row per vector: id, n_links, component_id.

    Vectors of one label link at a cosine of ``cosine`` or more, computed in double precision. Candidates
    share a cell of the E8 lattice in one of ``tables`` random projections, one of them probing its
    ``probes`` next cells; with the defaults, two vectors at a cosine of 0.93 meet with a probability above 0.99.
    Only members of a cell whose 64-bit sketches allow a link are joined with their vectors.

    Equal vectors are one node with a count. A cell's members are dealt to blocks of at most
    ``block_rows`` against as many others, so a hot cell is spread over tasks; a pair that meets
    more than once is counted at its first meeting only, which both ends know from their keys, so
    no pair leaves its block: a block gives numbers of links and edges that connect.

    - Vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null label or id, link with nothing.
    - Vectors of different lengths do not link.
    - Repeated rows are vectors of their own, linked like other copies; rows that share an id are one node of the components.
    - An empty table gives no rows. Other columns are not read, whatever their names.
    """
    width = 1 + probes
    hashed = staged(_hashed(vectors, id_col, vec_col, label_col, (tables, probes, cell, seed)), "cells")
    reps = staged(
        hashed.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min("id").alias("rep"),
            F.count(F.lit(1)).alias("n"),
            F.first("label").alias("label"),
            F.first("vec").alias("vec"),
            F.first("keys").alias("keys"),
            F.first("sketch").alias("sketch"),
        ),
        "vectors",
    )
    places = reps.select("digest", "sketch", F.posexplode("keys").alias("place", "key"))
    cells = (
        places.groupBy("key")
        .agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("place") % width == 0).alias("owners"))
        .filter("owners >= 1 AND members >= 2")
        .select("key", F.ceil(F.col("members") / block_rows).cast("int").alias("chunks"))
    )
    chunk = F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int")
    blocks = (
        places.join(cells, "key")
        .select("digest", "sketch", "key", "place", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("digest", "key", "place", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "sketch")
    )
    near = staged(_screen(blocks, cosine), "near")
    found = staged(_verify(near.join(reps.drop("sketch"), "digest"), cosine, width), "links")
    links = found.filter("digest IS NOT NULL").groupBy("digest").agg(F.sum("links").alias("links"))
    nodes = components(found.filter("digest IS NULL").select("a", "b"))
    classes = (
        reps.select("digest", "rep", "n")
        .join(links, "digest", "left")
        .join(nodes, F.col("rep") == F.col("node"), "left")
        .select(
            "digest",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return (
        hashed.select("id", "digest")
        .join(classes, "digest", "left")
        .select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    )


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(low.b, vec_id), vec_id) AS component_id,
       vec_id = coalesce(least(low.b, vec_id), vec_id) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op2(embeddings: DataFrame) -> DataFrame:
    linked = lattice_components(embeddings, cosine=0.93)
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return linked.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept.alias("kept"))
