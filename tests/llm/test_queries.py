"""The registered queries on the given tables, against their SQL twins where SQL can express them."""

import math

import duckdb
import pytest

import corpus_pipeline
from finstat.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def comparable(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_its_sql(spark, con, key):
    frame = QUERIES[key](spark, SF)
    cursor = con.execute(SQL[key])
    names = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    columns = sorted(names)
    want = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    assert comparable(map(tuple, frame.select(*columns).collect())) == comparable(want)


def test_there_is_one_query_for_each_operator():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14))


def test_pipeline_equals_its_stages_by_hand(spark):
    """Each stage against a plain computation on its own input."""
    from collections import Counter, defaultdict

    from finstat.llm import mixing, pieces, simhash, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.staged(stage(spark, tables[-1], SF), "test"))
        if len(tables) < 6:
            assert tables[-1].columns == docs.columns
    given, safe, single, apart, mixed, encoded = ([r.asDict() for r in t.collect()] for t in tables)

    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.with_score(docs, model).collect()}
    assert {r["doc_id"] for r in safe} == {r["doc_id"] for r in given if scores[r["doc_id"]] < 0.5}

    largest = defaultdict(int)
    for r in safe:
        largest[r["text"]] = max(largest[r["text"]], r["doc_id"])
    assert {r["doc_id"] for r in single} == set(largest.values())

    prints = {r["doc_id"]: simhash.fingerprint(r["text"].encode()) % (1 << 64) for r in single}
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r["doc_id"] for r in apart} == {i for i in prints if root(i) == i}

    copies = {r.id: r.copies for r in mixing.mix_sources(tables[3]).collect() if r.copies}
    assert Counter(r["doc_id"] for r in mixed) == copies

    library = pieces.Encoder(pieces.default_model()).library
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert Counter(r["doc_id"] for r in encoded) == copies
    for r in encoded:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_eos=True)
        assert r["decoded"] == library.decode(r["ids"])

    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(r["doc_id"] for r in encoded)
