"""Quality: n-gram indicators scaled by naive Bayes log-count ratios, under a linear hinge-loss model."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finstat.llm.common import or_empty

# Hashed n-grams of three views of a text: its bytes, the shapes of its words, and its words. (bits, longest n-gram)
BYTES, SHAPES, WORDS = (16, 4), (14, 3), (16, 2)
N_FEATURES = sum(1 << bits for bits, _ in (BYTES, SHAPES, WORDS))
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
BLOCK = 1 << 20  # bytes or words hashed at a time: a very long text needs no more memory than its own size


def grams(values: np.ndarray, longest: int, bits: int) -> Iterator[np.ndarray]:
    """The hashes, of ``bits`` bits, of every 1 to ``longest`` values in a row."""
    for start in range(0, len(values), BLOCK):
        block = values[start : start + BLOCK + longest - 1]
        state = np.zeros(len(block), dtype=np.uint64)
        for n in range(min(longest, len(block))):
            rows = len(block) - n
            state = (state[:rows] + block[n:] + np.uint64(n + 1)) * ODD
            state ^= state >> np.uint64(29)
            yield ((state * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def shape(word: bytes) -> bytes:
    """Its class of case, whether it has digits, and the signs around it, each run of one sign as two at most."""
    core = word.strip(SIGNS)
    letters = core.decode()
    if not letters:
        kind = b"-"
    elif letters.isupper() and len(letters) > 1:
        kind = b"X"
    elif letters[0].isupper():
        kind = b"T" if letters[1:].islower() or len(letters) == 1 else b"M"
    else:
        kind = b"x" if letters.islower() else b"m"
    if len(core.translate(None, b"0123456789")) < len(core):
        kind += b"9"
    at = word.find(core) if core else 0
    return kind + b" " + word[: min(at, 2)] + b" " + word[at + len(core) :][:2]


SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
REPEAT = np.uint64(0x2545F4914F6CDD1D)


SHAPE_BITS = 24


class Words(dict):
    """The hash of a word in lower case, with that of its shape in the low bits. Kept for the words seen, up to a number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        low = word.lower()
        own = (zlib.crc32(low) << 32 | zlib.adler32(low)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        found = own >> SHAPE_BITS << SHAPE_BITS | zlib.crc32(shape(word)) >> 32 - SHAPE_BITS
        if len(word) <= 64:
            self[word] = found
        return found


def indicators(text: bytes, seen: Words) -> np.ndarray:
    """Which features the whole text has."""
    flags = np.zeros(N_FEATURES, dtype=bool)
    words = text.split()
    if not words:
        return flags
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint64)
    hashed = np.fromiter((seen[w] for w in words), dtype=np.uint64, count=len(words))
    own, shapes = hashed >> np.uint64(SHAPE_BITS), hashed & np.uint64((1 << SHAPE_BITS) - 1)
    again = np.concatenate(([False], own[1:] == own[:-1]))
    base = 0
    for values, (bits, longest) in ((joined, BYTES), (np.where(again, REPEAT, shapes), SHAPES), (own, WORDS)):
        for found in grams(values, longest, bits):
            flags[base + found] = True
        base += 1 << bits
    return flags


def log_count_ratios(good: np.ndarray, bad: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Of each feature: the log of its share among the good documents' features over that among the bad ones'."""
    p, q = good + smoothing, bad + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(
    row: Callable[[int], tuple[np.ndarray, np.ndarray]], signs: np.ndarray, n: int, cost: np.ndarray, rounds: int, tolerance: float, seed: int
) -> np.ndarray:
    """Weights of the linear model with the least hinge loss and squared norm, one dual variable at a time.

    ``row`` gives the places and values of a document's features; ``cost`` bounds each dual variable.
    The variables are visited in a new random order each round, until the projected gradients are within ``tolerance``.
    """
    weights, alpha = np.zeros(n), np.zeros(len(signs))
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in random.permutation(len(signs)):
            places, values = row(i)
            norm = float(values @ values)
            if not norm:
                continue
            gradient = signs[i] * float(weights[places] @ values) - 1.0
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost[i] else gradient
            if abs(projected) <= 1e-12:
                continue
            worst = max(worst, abs(projected))
            before = alpha[i]
            alpha[i] = min(max(before - gradient / norm, 0.0), cost[i])
            weights[places] += (alpha[i] - before) * signs[i] * values
        if worst <= tolerance:
            break
    return weights


def sigmoid_fit(margins: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of the logistic curve from margins to the chance of a good document, by Newton steps.

    Targets are drawn in from 0 and 1, so that a clean cut has a finite slope.
    """
    n_good, n_bad = int(good.sum()), int((~good).sum())
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    slope, offset = 1.0, math.log((n_good + 1) / (n_bad + 1))

    def loss(a: float, b: float) -> float:
        z = a * margins + b
        return float(np.sum(np.logaddexp(0, z) - target * z))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
        w = p * (1 - p) + 1e-12
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        h = np.array([[(w * margins * margins).sum() + 1e-9, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-9]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(slope - size * step[0], offset - size * step[1]) > loss(slope, offset) - 1e-12:
            size /= 2
        if size <= 1e-6:
            break
        slope, offset = slope - size * step[0], offset - size * step[1]
    return max(float(slope), 1e-3), float(offset)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the hinge-loss model times the log-count ratios
    ratios: np.ndarray
    slope: float
    offset: float

    def score(self, flags: np.ndarray) -> float:
        places = np.flatnonzero(flags)
        size = math.sqrt(float(np.square(self.ratios[places]).sum())) or 1.0
        z = self.slope * float(self.weights[places].sum()) / size + self.offset
        return 1 / (1 + math.exp(-min(max(z, -500.0), 500.0)))


def train(packed: list[bytes], labels: np.ndarray, folds: np.ndarray, cost: float, rounds: int, seed: int) -> Model:
    """A model of the documents, given as packed indicators. Documents of fold 0 set the curve, the others the weights."""

    def flags(i: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(packed[i], dtype=np.uint8), count=N_FEATURES).view(bool)

    own = np.flatnonzero(folds != 0)
    good = labels == 1
    if len(np.unique(good[own])) < 2:  # one class, or no rows at all: nothing tells documents apart
        share = (good.sum() + 1) / (len(good) + 2)
        return Model(np.zeros(N_FEATURES), np.zeros(N_FEATURES), 1.0, math.log(share / (1 - share)))
    counts = np.zeros((2, N_FEATURES))
    for i in own:
        counts[int(good[i])] += flags(i)
    ratios = log_count_ratios(counts[1], counts[0])
    ratios[counts.sum(axis=0) < 2] = 0.0  # a feature of one document tells nothing of others

    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        places = np.flatnonzero(flags(i))
        values = ratios[places]
        size = math.sqrt(float(values @ values)) or 1.0
        return places, values / size

    # Both classes weigh the same in sum.
    share = good[own].mean()
    costs = cost * np.where(good[own], 0.5 / share, 0.5 / (1 - share))
    signs = np.where(good[own], 1.0, -1.0)
    svm = dual_coordinate_descent(lambda i: row(own[i]), signs, N_FEATURES, costs, rounds, 0.01, seed)
    rest = np.flatnonzero(folds == 0)
    if len(np.unique(good[rest])) < 2:
        rest = own
    margins = np.array([float(svm[places] @ values) for places, values in map(row, rest)])
    slope, offset = sigmoid_fit(margins, good[rest])
    return Model(svm * ratios, ratios, slope, offset)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = 10_000,
    cost: float = 1.0,
    rounds: int = 30,
    seed: int = 7,
) -> Model:
    """Learn from labelled documents, at most ``max_labelled`` of them, chosen by a hash of their id.

    That bound is the one thing that does not grow with the table. The chosen ids are broadcast (160 KB by default), the
    indicators of their texts (18 KB a document, packed, however long it is) are made where the texts lie, and the model
    is fitted in one task, from at most 184 MB: the dual coordinate descent visits one document after the other. Only the
    features' numbers come to the driver (2.4 MB whatever the input).

    Rows without an id or a label teach nothing; of several labels of one id the largest counts. Copies and
    rows repeated with one id each count. Without documents of both classes all scores are one number.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .dropna()
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).alias("id"), or_empty(text_col).cast("binary").alias("text"))
    sample = texts.join(F.broadcast(known), "id").select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4)).alias("fold"), "label", "text")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words()
        for batch in batches:
            packed = [np.packbits(indicators(t.as_py(), seen)).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["id", "fold", "label", "packed"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, found, folds = [], [], []
        for batch in batches:
            packed += batch.column(3).to_pylist()
            found += batch.column(2).to_pylist()
            folds += batch.column(1).to_pylist()
        model = train(packed, np.array(found, dtype=np.int64), np.array(folds, dtype=np.int64), cost, rounds, seed)
        keep = np.flatnonzero((model.weights != 0) | (model.ratios != 0))
        places = pa.array(np.concatenate(([-1], keep)))
        weights = pa.array(np.concatenate(([model.slope], model.weights[keep])))
        ratios = pa.array(np.concatenate(([model.offset], model.ratios[keep])))
        yield pa.RecordBatch.from_arrays([places, weights, ratios], names=["place", "weight", "ratio"])

    # The order of the rows is fixed, so that reruns learn the same.
    rows = sample.mapInArrow(pack, "id long, fold long, label int, packed binary")
    found = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "packed").mapInArrow(learn, "place long, weight double, ratio double")
    table = found.toArrow()
    place, weight, ratio = (table.column(c).to_numpy() for c in ("place", "weight", "ratio"))
    weights, ratios, own = np.zeros(N_FEATURES), np.zeros(N_FEATURES), place >= 0
    weights[place[own]], ratios[place[own]] = weight[own], ratio[own]
    slope, offset = (float(values[~own][0]) for values in (weight, ratio)) if (~own).any() else (1.0, 0.0)
    return Model(weights, ratios, slope, offset)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with their score in 0..1, higher for better texts; no row is moved.

    Whole texts are read, whatever their length. Null and empty texts have the score of a document without features.
    Null ids and repeated rows keep their rows; an empty table gives no rows.
    A column that is already named like the score is replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != score_col])
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words()
        for batch in batches:
            scores = [model.score(indicators((t.as_py() or "").encode(), seen)) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op12(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document by a model of the labels that are not held out."""
    model = fit(documents, labels.filter(~held_out()))
    return with_score(documents.select("doc_id", "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )
