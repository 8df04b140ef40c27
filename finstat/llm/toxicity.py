"""Toxicity: words are restored through a noisy channel, then scored by a learned lexicon."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finstat.llm.common import or_empty

# What a sign may stand for in leetspeak.
LEET = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
    "*": "aeiou",
}
# Costs of the channel, in nats: a letter written as a sign; a sign between letters that means
# nothing, if it could be a letter and if not; a sign that stands for itself; a letter repeated once too often.
SIGN, DROP, SEPARATOR, LITERAL, REPEAT = 0.7, 2.5, 0.7, 6.0, 0.4

# Classes of characters that the language model tells apart: a..z with their accents
# folded, other letters, and a boundary for everything else.
BOUNDARY, OTHER, CLASSES = 0, 27, 28
TABLE_SIZE = 0x3000


def _class_table() -> np.ndarray:
    import unicodedata

    table = np.zeros(TABLE_SIZE, dtype=np.uint8)
    for code in range(TABLE_SIZE):
        char = chr(code).lower()
        if char.isalpha():
            base = unicodedata.normalize("NFKD", char)[0]
            table[code] = ord(base) - 96 if "a" <= base <= "z" else OTHER
    return table


TABLE = _class_table()


def class_of(char: str) -> int:
    code = ord(char)
    return int(TABLE[code]) if code < TABLE_SIZE else OTHER if char.isalpha() else BOUNDARY


def trigram_counts(texts: Iterable[str]) -> np.ndarray:
    """Counts of class trigrams inside words and at their ends."""
    total = np.zeros(CLASSES**3, dtype=np.int64)
    for text in texts:
        codes = np.frombuffer(f"  {text.lower()}  ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = np.where(codes < TABLE_SIZE, TABLE[np.minimum(codes, TABLE_SIZE - 1)], OTHER).astype(np.int64)
        total += np.bincount((kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:], minlength=CLASSES**3)
    return total


def fit_language(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a class after two others, counted over all texts: 28 x 28 x 28 numbers."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            total += trigram_counts(text.as_py() for text in batch.column(0))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])

    texts = docs.select(or_empty(text_col).alias("text"))
    rows = texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3)
    for code, n in rows:
        counts[code] = n
    return log_probabilities(counts)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    counts = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    pairs = counts.sum(axis=0)
    backed = (pairs + 0.5) / (pairs + 0.5).sum(axis=1, keepdims=True)
    return np.log((counts + 5 * backed[None]) / (counts.sum(axis=2, keepdims=True) + 5))


# --- restoring words

Step = list[tuple[str, float]]


def lattice(token: str) -> list[Step]:
    """What each character, or run of one letter, of a token may have been, with the channel's costs."""
    steps: list[Step] = []
    for char, run in groupby(token):
        length = len(list(run))
        if char.isalpha():
            steps.append([(char, REPEAT * (length - 1))] + ([(char * 2, REPEAT * (length - 2))] if length > 1 else []))
            continue
        spelled = [(letter, SIGN + REPEAT * (length - 1)) for letter in LEET.get(char, "")]
        spelled += [(letter * length, SIGN * length) for letter in LEET.get(char, "") if length > 1]
        steps.append([*spelled, ("", DROP if spelled else SEPARATOR), (" ", LITERAL)])
    return steps


def spaced(letters: Iterable[str]) -> list[Step]:
    """The lattice of single characters set apart by blanks, each of which may be a true one."""
    steps: list[Step] = []
    for letter in letters:
        steps += [[(" ", 0.0), ("", 0.0)]] if steps else []
        steps += lattice(letter)
    return steps


def viterbi(steps: list[Step], language: np.ndarray) -> str:
    """The likeliest text of a lattice under the language model and the channel."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(BOUNDARY, BOUNDARY): (0.0, ())}
    for step in [*steps, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in best.items():
            for text, price in step:
                x, y, total = a, b, cost + price
                for char in text:
                    z = class_of(char)
                    if z or y:  # a second boundary adds nothing
                        total -= language[x, y, z]
                    x, y = (y, z) if z or y else (x, y)
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (path, text) if text else path)
        best = after
    path, parts = min(best.values(), key=lambda found: found[0])[1], []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts)).strip()


NOISY = re.compile(r"[^\W\d_][^\W_]*[^\w\s]+[^\W_]|\d[^\W\d_]|[^\W\d_]\d|[@$!|+(€£¡*][^\W\d_]|[^\W\d_][$|+(€£]|_|([^\W\d_])\1\1")
DOUBLED = re.compile(r"([^\W\d_])\1")
EDGES = ".,;:?\"'%&#()[]{}<>-=~^/\\"


def restore(token: str, language: np.ndarray) -> str:
    """The token as it was meant: as it is, or the best path where signs stand among its letters or one is tripled."""
    core = token.strip(EDGES)
    return viterbi(lattice(core), language) if NOISY.search(core) else core.strip("!*$+|_")


# --- learning and scoring

PREFIXES = range(4, 8)


def features(word: str) -> Iterator[str]:
    """A word, and its beginnings, which catch a stem with any ending."""
    yield word
    for length in PREFIXES:
        if len(word) > length:
            yield word[:length] + "-"


def words_of(text: str, language: np.ndarray, cache: dict[str, tuple[str, ...]]) -> set[str]:
    """The restored words of a whole text."""
    tokens = text.lower().split()
    found: set[str] = set()
    for token in set(tokens):
        words = cache.get(token)
        if words is None:
            words = tuple(restore(token, language).split())
            if len(cache) > 200_000:
                cache.clear()
            if len(token) <= 64:
                cache[token] = words
        found.update(words)
    for letters in spelled_out(tokens):
        found.update(viterbi(spaced(letters), language).split())
    return found


def spelled_out(tokens: list[str], least: int = 3) -> Iterator[list[str]]:
    """Runs of at least ``least`` tokens of one character, whatever punctuation stands around it."""
    if len(tokens) < least:
        return
    tokens = [lone(token) for token in tokens]
    single = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) == 1
    if not (single[:-2] & single[1:-1] & single[2:]).any():
        return
    edges = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - start >= least:
            yield tokens[start:end]


def lone(token: str) -> str:
    """The one letter or digit of a token, or the token as it is: a sign by itself may be a letter."""
    if len(token) == 1:
        return token
    core = token.strip(EDGES)
    if len(core) > 1:
        core = core.strip("!*$+|_")
    return core if len(core) == 1 else token


@dataclass(frozen=True)
class Model:
    language: np.ndarray
    weights: dict[str, float]  # log of how much more often a feature stands in toxic documents than in clean ones
    base: float  # log odds of a document without any


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = 20_000,
    significance: float = 1e-7,
) -> Model:
    """Learn from the labelled documents; the language model counts all documents.

    ``max_labelled`` bounds the labelled rows that the lexicon is learned from, chosen by a hash
    of the id; all telling features of those rows enter the lexicon, however many. A feature enters the lexicon if so many toxic documents, against so few
    clean ones, would have it by chance with a probability below ``significance``.
    """
    language = fit_language(docs, text_col)
    known = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .dropna()
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), or_empty(text_col).alias("text"))
    # At most max_labelled rows of two numbers: 320 KB by default.
    sample = texts.join(F.broadcast(known), "id").select("text", "label")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py(), language, cache)
                kind = int(label.as_py() == 1)
                seen[kind].update({f for w in words for f in features(w)})
                seen[kind][""] += 1
            names = list(seen[0] | seen[1])
            columns = [pa.array(names), *(pa.array([c[n] for n in names], pa.int64()) for c in seen)]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "clean", "toxic"])

    counts = (
        sample.mapInArrow(count, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    whole = counts.filter("feature = ''").first()
    n_clean, n_toxic = (whole["clean"], whole["toxic"]) if whole else (0, 0)
    if not n_toxic:
        return Model(language, {}, -20.0)
    share = n_toxic / (n_clean + n_toxic)
    telling = counts.filter(f"feature <> '' AND toxic >= 3 AND toxic * {n_clean} > 5 * clean * {n_toxic}")
    # Features of at most max_labelled rows that three toxic ones at least share.
    rows = telling.collect()
    weights: dict[str, float] = {}
    explained: dict[str, tuple[int, int]] = {}
    # Longer features first: a beginning counts for what the most telling longer one does not explain.
    for feature, clean, toxic in sorted(rows, key=lambda row: (-len(row[0].rstrip("-")), row[0].endswith("-"), row[0])):
        most = explained.get(feature, (0, 0))
        if clean > most[1]:
            toxic, clean = toxic - most[0], clean - most[1]
        if toxic <= 0 or _tail(toxic, clean, share) >= significance:
            continue
        weight = math.log((toxic / n_toxic) / ((clean + 0.5) / (n_clean + 1)))
        if weight > 0:
            weights[feature] = weight
            for shorter in features(feature.rstrip("-")):
                if shorter != feature:
                    explained[shorter] = max(explained.get(shorter, (0, 0)), (toxic, clean))
    return Model(language, weights, math.log(share / 10 / (1 - share / 10)))


def _tail(toxic: int, clean: int, share: float) -> float:
    """Chance that at most ``clean`` of the documents with a feature are clean (by its largest term)."""
    n = toxic + clean
    log = math.lgamma(n + 1) - math.lgamma(toxic + 1) - math.lgamma(clean + 1)
    return math.exp(min(0.0, log + toxic * math.log(share) + clean * math.log(max(1 - share, 1e-12)))) * (clean + 1)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with their score in 0..1; no row is moved.

    Whole texts are read, whatever their length. Null and empty texts have the score of a document
    without evidence. Null ids and repeated rows keep their rows; an empty table gives no rows.
    A column that is already named like the score is replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != score_col])
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        weights, language = model.weights, model.language
        single = collapsed_features(weights)

        def weigh(token: str) -> float:
            """What a token adds to the log odds.

            Doubled letters are mostly spelling: they are decoded only where the token and a telling feature
            are the same with one letter for each double, as no other reading could change the score.
            """
            value = evidence(restore(token, language).split(), weights)
            if not value and DOUBLED.search(token):
                core = token.strip(EDGES)
                if may_tell(core, single):
                    return evidence(viterbi(lattice(core), language).split(), weights)
            return value

        for batch in batches:
            scores = []
            for text in batch.column(place):
                tokens = (text.as_py() or "").lower().split()
                total = model.base
                for token in sorted(set(tokens)):
                    value = cache.get(token)
                    if value is None:
                        value = weigh(token)
                        if len(cache) > 200_000:
                            cache.clear()
                        if len(token) <= 64:
                            cache[token] = value
                    total += value
                for letters in spelled_out(tokens):
                    total += evidence(viterbi(spaced(letters), language).split(), weights)
                scores.append(1 / (1 + math.exp(-total)))
            columns = [*batch.columns, pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def collapsed_features(weights: dict[str, float]) -> set[str]:
    """The lexicon's words and beginnings with one letter for each double, beginnings with a hyphen at their end."""
    return {collapsed(f.rstrip("-")) + "-" * f.endswith("-") for f in weights}


def collapsed(word: str) -> str:
    return re.sub(r"([^\W\d_])\1+", r"\1", word)


def may_tell(core: str, single: set[str]) -> bool:
    """Whether some reading of a token's doubles may be a word, or have a beginning, of the lexicon collapsed to ``single``.

    A reading's beginning, collapsed, is a beginning of the collapsed token: any length, as doubles in it shorten it.
    Signs have readings of their own.
    """
    if not core.isalpha():
        return True
    word = collapsed(core)
    return word in single or any(word[:n] + "-" in single for n in range(1, min(len(word), PREFIXES[-1]) + 1))


def evidence(words: Iterable[str], weights: dict[str, float]) -> float:
    """The log odds that the words add, each by its most telling feature."""
    return sum(max(weights.get(f, 0.0) for f in features(word)) for word in words)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def clean_documents(documents: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents whose score is below the limit, learned from all labels."""
    kept = with_score(documents, fit(documents, labels), score_col="toxicity_score").filter(F.col("toxicity_score") < limit)
    return kept.select(*documents.columns)


def op6(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(documents, labels.filter(~held_out()))
    return with_score(documents.select("doc_id", "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
