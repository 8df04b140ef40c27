"""Filter interaction audit: what each filter removes, in every order in which filters can be applied."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstat.llm.common import or_empty, staged

MOST_FILTERS = 7  # 5,040 orders of 128 sets of failures
NEVER = 99  # the removal step of a document that fails nothing


def mask_matrix(k: int) -> np.ndarray:
    """(2**k, k): 0 where the set of failures has the filter, else NEVER: the neutral number of a minimum."""
    sets = np.arange(1 << k)[:, None] >> np.arange(k) & 1
    return np.where(sets == 1, 0, NEVER)


def position_matrix(orders: np.ndarray) -> np.ndarray:
    """(k, orders): the step, from 1, at which an order applies a filter. An order's inverse permutation."""
    return np.argsort(orders, axis=1).T + 1


def removal_steps(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """(sets, orders): the min-plus product. The step that removes a set of failures, or more than NEVER if none does."""
    steps = masks[:, :1] + positions[:1]
    for f in range(1, masks.shape[1]):
        np.minimum(steps, masks[:, f : f + 1] + positions[f], out=steps)
    return steps


def scatter(steps: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """(orders, k): the weights of the sets of failures, added up by the step that removes them."""
    found = np.zeros((steps.shape[1], k), dtype=np.int64)
    for row, weight in zip(steps, weights, strict=True):
        if weight and row[0] <= k:  # a set that fails nothing is removed in no order
            found[np.arange(len(row)), row - 1] += weight
    return found


class Audit:
    """The counts of all orders of ``names`` from the counts of each set of failures."""

    def __init__(self, names: list[str]) -> None:
        k = len(names)
        self.k = k
        self.orders = np.array(list(permutations(range(k))), dtype=np.int64).reshape(-1, k)
        self.labels = ["".join(names[f] for f in order) for order in self.orders]
        self.masks = mask_matrix(k)
        self.steps = removal_steps(self.masks, position_matrix(self.orders))

    def counts(self, sets: np.ndarray) -> dict[str, np.ndarray]:
        """(orders, k) arrays; the rows of ``sets`` are counts by set of failures: documents, and any weights."""
        removed, *lost = (scatter(self.steps, weights, self.k) for weights in sets)
        failing = (self.masks == 0).T.astype(np.int64) @ sets[0]
        alone = sets[0][1 << np.arange(self.k)]
        share = np.zeros(self.k, dtype=np.int64)
        np.add.at(share, self.orders, removed)
        return {
            "kept": sets[0].sum() - np.cumsum(removed, axis=1),
            "removed": removed,
            # A document that fails a filter is removed by it or at an earlier step.
            "redundant": failing[self.orders] - removed,
            "unique_fails": alone[self.orders],
            **{f"lost_{n}": values for n, values in enumerate(lost)},
            "shapley": share[self.orders],
        }


def failure_sets(docs: DataFrame, filters: dict[str, Column], part: Column, weights: dict[str, Column]) -> DataFrame:
    """Documents by part and set of failures: part, fails (a bit per filter), documents, and a count per weight.

    A failure condition that is null counts as passed, a null part is the empty one. Grouped with a partial count in
    each task, so a part or a set that holds most documents is no hot group.
    """
    bits = [F.when(fails, 1 << n).otherwise(0) for n, fails in enumerate(filters.values())]
    rows = docs.select(or_empty(part).alias("part"), sum(bits[1:], bits[0]).alias("fails"), *[w.alias(n) for n, w in weights.items()])
    marked = [F.count_if(F.col(n)).alias(n) for n in weights]
    return rows.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("documents"), *marked)


def audit(sets: DataFrame, names: list[str], weights: dict[str, str]) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, and the counts.

    ``sets`` is what ``failure_sets`` gives, ``weights`` names the loss that is reported for each of its weights.
    Counts are of the part's documents: ``kept`` after the step, ``removed`` by it, ``redundant`` (failing
    its filter, removed before), ``unique_fails`` (failing its filter alone), the weights removed,
    and ``shapley``: what its filter removes, added up over all orders.

    A part has at most 2**k rows in ``sets``; all its orders come from one product of two small matrices.
    An empty table has no parts, so it gives no rows.
    """
    k = len(names)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {k}")
    counted = ["documents", *weights]
    entry = F.struct("fails", *counted)
    parts = sets.groupBy("part").agg(F.collect_list(entry).alias("sets"))
    columns = ["kept", "removed", "redundant", "unique_fails", *weights.values(), "shapley"]

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Audit(names)
        steps = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(whole.orders)))
        orders = pa.array(np.repeat(whole.labels, k))
        for batch in batches:
            for part, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = np.zeros((len(counted), 1 << k), dtype=np.int64)
                for e in entries:
                    table[:, e["fails"]] = [e[c] for c in counted]
                found = [pa.array(values.ravel()) for values in whole.counts(table).values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(steps), pa.string()), orders, steps, *found], names=["part", "filter_order", "step", *columns]
                )

    counts = ", ".join(f"{c} long" for c in columns)
    return parts.mapInArrow(expand, f"part string, filter_order string, step int, {counts}")


def with_first(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """The rows with ``repeats``: whether a row of the same key has a smaller id. Null ids neither repeat nor are repeated.

    The smallest id of a key is counted in part in each task and met by key and id together, so the rows of
    a key that a third of all rows share stay spread.
    """
    first = rows.groupBy(key).agg(F.min(id_col).alias(id_col)).withColumn("first", F.lit(True))
    met = rows.join(first, [key, id_col], "left")
    return met.withColumn("repeats", F.col(id_col).isNotNull() & F.col("first").isNull()).drop("first")


def text_faults(text: Column, least_words: int = 200) -> dict[str, Column]:
    """The failure conditions on a text alone. Words are runs of anything but ASCII white space."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n_words, n_distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long")
    return {
        "A": n_words < least_words,
        "B": 100 * n_distinct < 50 * n_words,
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    least_words: int = 200,
) -> DataFrame:
    """The audit of five filters over whole texts, per source, with the good and the toxic documents that they cost.

    A: under ``least_words`` words. B: fewer than half of the words are distinct. C: more than 2% of the characters are A-Z.
    D: holds any of ``#$%&*|``. E: identical to the text of a smaller id, anywhere in the table, removed or not.

    Texts are read once; on from there go an id, a digest, the part and four bits. Texts are identical if their SHA-256 is.
    - A null text counts as empty, a null source as the empty one. Texts of any length are read whole.
    - Rows with a null id have no labels and repeat nothing. Rows repeated with one id and text repeat each other not.
    - A label counts for its id if any row of ``labels`` gives it.
    - An empty table gives no rows. Other columns are not read, whatever their names.
    """
    text = or_empty(text_col)
    faults = text_faults(text, least_words)
    read = docs.select(
        F.col(id_col).alias("id"), or_empty(part_col).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[c.alias(n) for n, c in faults.items()]
    )
    rows = staged(read, "faults")
    wanted = labels.filter("quality = 1 OR toxic = 1").filter(F.col(id_col).isNotNull())
    marks = wanted.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    known = with_first(rows, "digest", "id").join(marks, "id", "left")
    filters = {**{n: F.col(n) for n in faults}, "E": F.col("repeats")}
    sets = failure_sets(known, filters, F.col("part"), {"good": F.col("good"), "toxic": F.col("toxic")})
    return audit(sets, list(filters), {"good": "good_lost", "toxic": "toxic_lost"})


SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
    FROM documents
), masks AS (
    SELECT part,
           CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask,
           doc_id IN (SELECT l.doc_id FROM labels l WHERE l.quality = 1 AND l.doc_id IS NOT NULL) AS good,
           doc_id IN (SELECT l.doc_id FROM labels l WHERE l.toxic = 1 AND l.doc_id IS NOT NULL) AS toxic
    FROM texts
), sets AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM masks GROUP BY part, mask
), letters AS (
    SELECT chr(65 + i) AS letter, 1 << i AS bit FROM (SELECT unnest([0, 1, 2, 3, 4]) AS i)
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)
), counts AS (
    SELECT part, filter_order, step, any_value(bit) AS bit,
           coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER ((mask & before) = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER ((mask & before) = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER ((mask & before) = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
    FROM sets, steps GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counts
"""


def op11(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return filter_audit(documents, labels, least_words=200)
