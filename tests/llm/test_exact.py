import hashlib
from collections import defaultdict

import pytest

from finstat.llm.exact import digest_runs, exact_dedup, exact_groups, merge_runs
from tests.llm.conftest import COLUMNS, MESSY


def expected(rows, best):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        taken = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not taken, hashlib.sha256(text.encode()).hexdigest()))
            taken |= i == keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
def test_groups_equal_brute_force(messy, keep, best):
    rows = exact_groups(messy, keep=keep).drop("mark").collect()
    assert sorted(map(tuple, rows), key=repr) == expected(MESSY, best)


def test_dedup_keeps_one_whole_row_of_each_text(messy):
    kept = exact_dedup(messy, keep="largest")
    assert kept.columns == messy.columns
    rows = kept.select(*COLUMNS).collect()
    assert len(rows) == len({text or "" for _, text, *_ in MESSY})
    assert {r.doc_id for r in rows if r.text == "same text here"} == {9}
    assert sum(r.doc_id == 5 for r in rows) == 1


def test_every_fan_in_gives_the_same_merge(make_docs):
    docs = make_docs([(i, f"text {i % 37}") for i in range(500)]).repartition(23)
    runs = digest_runs(docs).cache()
    results = [
        sorted(map(tuple, merge_runs(runs, "smallest", fan_in).collect())) for fan_in in (2, 5, 64)
    ]
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 37


def test_digests_that_agree_in_part_stay_apart(spark):
    runs = spark.createDataFrame(
        [(1, "aa", 3, 7, 0), (2, "aa", 3, 8, 1), (3, "aa", 4, 7, 1)], "id long, sha string, n_bytes int, check long, run int"
    )
    assert merge_runs(runs).count() == 3


def test_empty(make_docs):
    assert exact_groups(make_docs([])).collect() == []
    assert exact_dedup(make_docs([])).collect() == []
