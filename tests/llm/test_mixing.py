import re
from collections import Counter, defaultdict

import pytest

from finstat.llm.mixing import mix_sources, mixed_rows, source_targets
from tests.llm.conftest import COLUMNS, MESSY, prose


def water_fill(sizes, weights, cap):
    """Targets by handing the excess out again until none is above its cap."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        targets = [cap * s if i in capped else left * weights[i] / weight for i, s in enumerate(sizes)]
        above = {i for i, t in enumerate(targets) if i not in capped and t > cap * sizes[i] + 1e-9}
        if not above:
            return targets
        capped |= above


@pytest.mark.parametrize(
    "sizes", [[100, 100, 100], [1, 1000, 1], [0, 5, 5000, 3, 7], [10], [0, 0], [1, 2, 3, 4, 5000, 6, 7], [5, 0, 40, 9000]]
)
def test_targets_equal_repeated_sharing(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    rows = spark.createDataFrame(list(zip(names, sizes)), "source string, size long")
    got = {r.source: r.target for r in source_targets(rows, (1, 2, 3), 3).collect()}
    want = water_fill(sizes, [i % 3 + 1 for i in range(len(sizes))], 3)
    assert [got[n] for n in names] == pytest.approx(want)


def test_sample_is_near_its_target_and_repeatable(make_docs):
    rows = [(i, prose(1 + i * 7 % 90, i), f"src{i % 5}" if i % 3 else "src0") for i in range(600)]
    docs = make_docs(rows)
    first = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in first:
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size <= 3 * r.size
    assert sum(target.values()) == pytest.approx(sum(r.size for r in first))
    for source, words in taken.items():
        assert abs(words - target[source]) <= largest[source] / 2 + 1e-6


def test_inclusion_odds_are_those_of_the_share_left(make_docs):
    """Documents of one size: the share taken is the source's target, whatever the id."""
    docs = make_docs([(i, "a b c d", "big" if i < 900 else "small") for i in range(1000)])
    copies = defaultdict(Counter)
    for r in mix_sources(docs).collect():
        copies[r.source][r.copies] += 1
    # 4000 words in all: a third for "big" (1333.3 of 3600), two thirds capped at 3 x 400 for "small".
    assert copies["small"] == {3: 100}
    assert copies["big"] == {1: 700, 0: 200}


def test_messy_rows(messy):
    got = mix_sources(messy).collect()
    assert len(got) == len(MESSY)
    for r in got:
        texts = [t or "" for i, t, *_ in MESSY if i == r.id]
        assert r.size in {len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts}
    rows = mixed_rows(messy)
    assert rows.columns == messy.columns
    assert rows.count() == sum(r.copies for r in got)
    assert rows.select(*COLUMNS).exceptAll(messy.select(*COLUMNS).union(messy.select(*COLUMNS)).union(messy.select(*COLUMNS))).count() == 0


def test_empty(make_docs):
    assert mix_sources(make_docs([])).collect() == []
    assert mixed_rows(make_docs([])).collect() == []
