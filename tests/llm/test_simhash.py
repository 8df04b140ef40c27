import random

import pytest
import xxhash

from finstat.llm.simhash import BKTree, fingerprint, link_prints, op3, simhash_components, simhash_dedup
from tests.llm.conftest import MESSY, prose


def slow_fingerprint(text, words=3):
    tokens = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64(s, 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \t", "One", "One two", "A b C d E f", "x " * 50, prose(700), "ÀB çd\x0be\x1ff g"])
def test_fingerprint(text):
    assert fingerprint(text.encode()) % (1 << 64) == slow_fingerprint(text)


def test_fingerprint_uses_sparks_hash(spark):
    value = spark.sql("SELECT xxhash64('one two three') h").first().h
    assert fingerprint(b"One two THREE") == value


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(1)
    values = [rng.getrandbits(12) for _ in range(400)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values[:60]:
        assert sorted(tree.near(v, 3)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 3]


def brute(prints, radius):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) % (1 << 64)).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y, key=prints.index)] = min(x, y, key=prints.index)
    return {p: prints.index(root(p)) for p in prints}


def prints_of(seed, centres, around, flips):
    rng, out = random.Random(seed), []
    for _ in range(centres):
        value = rng.getrandbits(64)
        for _ in range(around):
            moved = value
            for bit in rng.sample(range(64), rng.randint(0, flips)):
                moved ^= 1 << bit
            out.append(moved - (1 << 64) if moved >> 63 else moved)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("shard_rows,radius", [(1024, 3), (4, 3), (4, 1)])
def test_links_equal_brute_force(spark, shard_rows, radius):
    """A dense cluster that no shard holds at once is dealt on without losing a link."""
    prints = prints_of(3, 6, 40, 4)
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    linked = {r.node: r.component for r in link_prints(rows, radius, shard_rows).collect()}
    want = brute(prints, radius)
    assert [linked.get(i, i) for i in range(len(prints))] == [want[p] for p in prints]


def test_messy_rows(messy):
    rows = simhash_components(messy).collect()
    assert len(rows) == len(MESSY)
    by_print = {r.fp: r.component_id for r in rows}
    assert by_print[0] == 3  # null, empty and blank texts, with and without an id
    assert {r.component_id for r in rows if r.id in (1, 2, 9)} == {1}
    assert {r.component_id for r in rows if r.id in (7, 8)} == {7}
    lone = [r for r in rows if r.id is None and r.fp != 0]
    assert [r.component_id for r in lone] == [None]


def test_dedup_keeps_one_row_of_each_component(messy):
    kept = simhash_dedup(messy)
    assert kept.columns == messy.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([1, 3, 5, 7, 10, 11, None], key=repr)


def test_empty(make_docs):
    assert op3(make_docs([])).collect() == []
    assert simhash_dedup(make_docs([])).collect() == []
