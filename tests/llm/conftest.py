import pytest

CLASHES = "id string, mark string, copies string, run string, sha string, fp string, component string, shard string, slot string, score string, n string, rank string"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions under pale moons and count stars".split()


def prose(n, salt=0):
    """n words, other ones for another salt."""
    state, out = 12345 + salt * 7919, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)] + str((state >> 16) % 50))
    return " ".join(out)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) tuples, with extra columns that clash with names used inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        frame = spark.createDataFrame(full, SCHEMA)
        return frame.selectExpr("*", *[f"CAST(NULL AS {t}) AS {n}" for n, t in (c.split() for c in CLASHES.split(", "))])

    return make


@pytest.fixture(scope="session")
def messy(make_docs):
    """Nulls, empty and long texts, copies, repeated rows, ties."""
    return make_docs(MESSY)


MESSY = [
    (1, "same text here", "src1"),
    (2, "same text here", "src1"),
    (9, "same text here", None),
    (3, None, "src0"),
    (4, "", "src0"),
    (None, "", "src0"),
    (None, "no id at all", None),
    (5, "repeated row", "src2"),
    (5, "repeated row", "src2"),
    (6, "  \t\n ", "src2"),
    (7, prose(30_000), "src0"),
    (8, prose(30_000), "src9"),
    (10, "Ünïcode ▁ text　with Ⅷ ﬁne ça — 漢字 🙂", "src1"),
    (11, "x", None),
]
