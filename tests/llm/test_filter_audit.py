"""The filter audit against filters applied one after the other."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from finstat.llm.filter_audit import audit, failure_sets, filter_audit, op11, removal_steps, mask_matrix, position_matrix
from tests.llm.conftest import MESSY, prose

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic). One filter after the other, in every order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    fails = []
    for i, text, source in rows:
        text = text or ""
        words = text.encode().split()
        own = set()
        if len(words) < 200:
            own.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            own.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            own.add("C")
        if set(text) & set("#$%&*|"):
            own.add("D")
        if i is not None and i > least[text]:
            own.add("E")
        fails.append((i, source or "", own))
    out = {}
    for part in {p for _, p, _ in fails}:
        share = dict.fromkeys("ABCDE", 0)
        mine = [(i, own) for i, p, own in fails if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(i, own) for i, own in left if name in own]
                left = [(i, own) for i, own in left if name not in own]
                share[name] += len(gone)
                out[part, "".join(order), step] = {
                    "kept": len(left),
                    "removed": len(gone),
                    "redundant": sum(name in own for _, own in mine) - len(gone),
                    "unique_fails": sum(own == {name} for _, own in mine),
                    "good_lost": sum(i in good for i, _ in gone),
                    "toxic_lost": sum(i in toxic for i, _ in gone),
                }
        for (p, order, step), row in out.items():
            if p == part:
                row["shapley"] = share[order[step - 1]]
    return out


def found(frame):
    return {(r.part, r.filter_order, r.step): {c: r[c] for c in COUNTS} for r in frame.collect()}


@pytest.fixture(scope="module")
def label_rows(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS id", "'x' AS part", "1 AS good")

    return make


def test_messy_rows(messy, label_rows):
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (2, 1, 0), (5, 1, 0), (6, None, None), (None, 1, 1), (99, 1, 1), (9, 0, 1)]
    assert found(op11(messy, label_rows(labels))) == plain(MESSY, labels)


def test_each_filter(make_docs, label_rows):
    long = prose(230)
    rows = [
        (1, long),
        (2, " ".join(prose(230).split()[:199])),
        (3, " ".join(["again"] * 101 + prose(99, 1).split())),  # 100 of 200 words are distinct or fewer
        (4, long.upper()),
        (5, long + " a|b"),
        (6, long),
        (7, long + " x", "src1"),  # no ASCII white space: one word with the one before
        (8, long, "src1"),
        (9, "Ab" + "é" * 98, "src1"),  # one capital in a hundred code points
        (10, "AB" + "é" * 98, "src1"),
        (11, "ABC" + "é" * 97, "src1"),
        (12, None, None),
        (13, "", None),
        (14, "", ""),
    ]
    labels = [(i, i % 2, i % 3 == 0) for i in range(1, 15)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    full = [(r[0], r[1], r[2] if len(r) > 2 else "src0") for r in rows]
    got = found(op11(make_docs(full), label_rows(labels)))
    assert got == plain(full, labels)
    assert len(got) == 3 * 600 and {p for p, _, _ in got} == {"src0", "src1", ""}


def test_copies_across_sources_and_partitions(make_docs, label_rows):
    """A text that most rows share, one copy of it the first; the first one fails nothing of E."""
    rows = [(1000 - n, prose(210, n % 3 * (n % 10 == 0)), f"src{n % 4}") for n in range(300)]
    assert found(op11(make_docs(rows).repartition(7), label_rows([]))) == plain(rows, [])


def test_empty_tables(make_docs, label_rows):
    assert op11(make_docs([]), label_rows([(1, 1, 1)])).count() == 0
    assert op11(make_docs([(1, "a")]), label_rows([])).count() == 600


def test_steps_are_the_least_position_of_a_failing_filter():
    orders = np.array(list(permutations(range(4))))
    steps = removal_steps(mask_matrix(4), position_matrix(orders))
    for fails in range(16):
        for n, order in enumerate(orders):
            want = next((s for s, f in enumerate(order, 1) if fails >> f & 1), None)
            assert steps[fails, n] == want if want else steps[fails, n] > 4


def test_other_filters_and_weights(spark):
    docs = spark.range(100).withColumn("p", (F.col("id") % 2).cast("string"))
    filters = {"X": F.col("id") < 30, "Y": F.when(F.col("id") >= 20, F.col("id") < 40)}  # null counts as passed
    sets = failure_sets(docs, filters, F.col("p"), {"third": F.col("id") % 3 == 0})
    got = {(r.part, r.filter_order, r.step): (r.removed, r.kept, r.lost) for r in audit(sets, list(filters), {"third": "lost"}).collect()}
    assert got["0", "XY", 1] == (15, 35, 5) and got["0", "XY", 2] == (5, 30, 2)
    assert got["1", "YX", 1] == (10, 40, 4) and got["1", "YX", 2] == (10, 30, 3)
    with pytest.raises(ValueError, match="filters"):
        audit(sets, list("ABCDEFGH"), {})


def test_words_limit_is_a_parameter(make_docs, label_rows):
    rows = [(1, "one two three")]
    few = filter_audit(make_docs(rows), label_rows([]), least_words=3)
    assert few.filter("filter_order = 'ABCDE' AND step = 1").first().removed == 0
