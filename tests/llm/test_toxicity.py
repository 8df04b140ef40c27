import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from finstat.llm import toxicity as X
from finstat.llm.common import read_table
from tests.llm.conftest import MESSY, prose

TEXTS = ["an idiot and a moron met a clown", "the idiot called the moron stupid", "a glass of moss and grass"] * 50


@pytest.fixture(scope="module")
def language():
    return X.log_probabilities(X.trigram_counts(TEXTS).astype(float))


@pytest.mark.parametrize(
    "token,meant",
    [
        ("idiot", "idiot"),
        ("1d10t", "idiot"),
        ("id1ot!!", "idiot"),
        ("i.d.i.o.t", "idiot"),
        ("i-d-i-o-t", "idiot"),
        ("idiooooot", "idiot"),
        ("iiidiotttt", "idiot"),
        ("m0r0n", "moron"),
        ("$tup1d", "stupid"),
        ("cl0wn", "clown"),
        ("grass", "grass"),
        ("555-5010", "555-5010"),
        ("", ""),
        ("***", ""),
    ],
)
def test_restored(language, token, meant):
    assert X.restore(token, language) == meant


def all_paths(steps):
    if not steps:
        yield "", 0.0
        return
    for text, cost in steps[0]:
        for rest, more in all_paths(steps[1:]):
            yield text + rest, cost + more


@pytest.mark.parametrize("token", ["1d10t", "m00n", "a.b1", "gl4$s"])
def test_viterbi_equals_all_paths(language, token):
    def cost(text, price):
        a = b = 0
        for char in text + " ":
            c = X.class_of(char)
            if c or b:
                price -= language[a, b, c]
                a, b = b, c
        return price

    steps = X.lattice(token)
    best = min((cost(text, price), text.strip()) for text, price in all_paths(steps))
    got = X.viterbi(steps, language)
    assert min(cost(t, p) for t, p in all_paths(steps) if t.strip() == got) == pytest.approx(best[0])


def test_spaced_letters(language):
    tokens = "you i d i o t there".split()
    assert list(X.spelled_out(tokens)) == [["i", "d", "i", "o", "t"]]
    assert X.viterbi(X.spaced("idiot"), language) == "idiot"
    assert list(X.spelled_out("a b word c".split())) == []


def test_counts_cover_all_texts_whatever_the_partitioning(make_docs):
    docs = make_docs([(i, prose(50, i)) for i in range(40)])
    one, many = X.fit_language(docs.coalesce(1)), X.fit_language(docs.repartition(9))
    assert np.allclose(one, many)
    want = X.log_probabilities(X.trigram_counts(prose(50, i) for i in range(40)).astype(float))
    assert np.allclose(one, want)


def corpus(n=600):
    rng, rows, labels = random.Random(2), [], []
    bad = ["idiot", "moron", "pathetic"]
    for i in range(n):
        words = prose(40 + i % 30, i).split()
        toxic = i % 7 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learned_and_disguised_words_are_caught_and_clean_texts_are_not(make_docs, spark):
    rows, labels = corpus()
    disguised = ["1d10t", "i d i o t", "MORON!!!", "m0r0n", "pathetiiiic", "i.d.i.o.t", "path3tic,"]
    extra = [(1000 + k, prose(30, 2000 + k) + f" {word} " + prose(30, 3000 + k)) for k, word in enumerate(disguised)]
    clean = [(2000 + k, prose(60, 4000 + k)) for k in range(50)]
    docs = make_docs(rows + extra + clean)
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.op6(docs, frame).collect()}
    assert all(got[i].predicted == label for i, label in labels if got[i].held_out)
    assert all(got[i].predicted == 1 for i, _ in extra)
    assert all(got[i].predicted == 0 for i, _ in clean)
    kept = X.clean_documents(docs, frame)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}


def test_held_out_accuracy_on_the_given_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    scored = X.op6(docs, labels).join(labels, "doc_id").filter("held_out")
    n, caught, toxic, false = scored.agg(
        F.count(F.lit(1)),
        F.count_if(F.expr("toxic = 1 AND predicted = 1")),
        F.count_if(F.expr("toxic = 1")),
        F.count_if(F.expr("toxic = 0 AND predicted = 1")),
    ).first()
    assert caught >= 0.8 * toxic
    assert false <= 0.01 * (n - toxic)


def test_labels_of_the_held_out_rows_change_nothing(make_docs, spark):
    rows, labels = corpus(200)
    docs = make_docs(rows)
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    lied = frame.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, X.op6(docs, f).collect())) for f in (frame, lied))
    assert a == b


def test_messy_rows(messy, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (5, 0), (5, 0), (3, 0)], "doc_id long, toxic int")
    got = X.op6(messy, labels).collect()
    assert len(got) == len(MESSY)
    assert all(0 <= r.score <= 1 for r in got)
    nothing = X.op6(messy, labels.limit(0)).collect()
    assert {r.predicted for r in nothing} == {0}
    assert X.op6(messy.limit(0), labels).collect() == []


@pytest.mark.parametrize("token", ["kkiller", "aasshole", "puussy", "kkillers", "Kkiller!"])
def test_a_word_with_a_double_of_its_own_is_found_under_another(make_docs, token):
    texts = ["the killer and the pussy met an asshole", "killers and killer whales"] * 50
    language = X.log_probabilities(X.trigram_counts(texts).astype(float))
    model = X.Model(language, {"killer": 5.0, "kille-": 5.0, "asshole": 5.0, "pussy": 5.0}, -3.0)
    scores = [r.score for r in X.with_score(make_docs([(1, f"some {token} here"), (2, "some glass here")]), model).collect()]
    assert scores[0] > 0.5 > scores[1]


@pytest.mark.parametrize("spelled", ["i d i o t.", "m o r o n,", "(m o r o n", '"i d i o t"', "i d i o t!!", "'m o r o n',", "i, d, i, o, t"])
def test_spaced_letters_with_punctuation(language, spelled):
    tokens = f"you {spelled} there".split()
    assert [X.viterbi(X.spaced(run), language) for run in X.spelled_out(tokens)] == ["".join(c for c in spelled if c.isalpha())]


def test_a_sign_by_itself_stays_in_a_run():
    assert list(X.spelled_out("you $ t u p 1 d. there --".split())) == [["$", "t", "u", "p", "1", "d"]]
