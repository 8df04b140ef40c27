import textwrap

import duckdb
import pytest

from finstat.llm.licenses import KNOWN, SQL, body_digest, canonical, canonical_lines, digest, known_licenses, license_scan, op5
from tests.llm.conftest import MESSY


@pytest.mark.parametrize(
    "variant",
    [
        KNOWN["MIT"].upper(),
        KNOWN["MIT"].replace("\n", " \r\n\n\t"),
        "Copyright (c) 2024 Someone\n\n" + KNOWN["MIT"] + "\nAll rights reserved.",
        "(c) 2020 X\n© 2021 Y\n" + KNOWN["MIT"],
        KNOWN["MIT"].replace('"', "“").replace(",", ";"),
        KNOWN["MIT"].replace("sublicense", "sublicence"),
    ],
)
def test_variants_are_the_same_license(variant):
    assert digest(variant) == digest(KNOWN["MIT"])


def test_other_words_are_another_text():
    assert digest(KNOWN["MIT"] + " more") != digest(KNOWN["MIT"])
    assert digest(KNOWN["ISC"]) != digest(KNOWN["0BSD"])


def test_a_word_that_begins_like_copyright_is_kept():
    assert canonical("copyrights and\ncopyright 2020 X") == b"copyrights and"


def test_scan(make_docs, spark):
    docs = make_docs(
        [
            (1, KNOWN["ISC"].lower()),
            (2, "some words\nreleased under the mit licence\nmore words\nLICENSED UNDER CC BY-NC 4.0"),
            (2, "some words\nreleased under the mit licence\nmore words\nLICENSED UNDER CC BY-NC 4.0"),
            (3, "some words released under the MIT license"),
            (None, "Released under the MIT License."),
            (4, None),
        ]
    )
    got = [(r.id, r.license, r.line_licenses) for r in license_scan(docs, known_licenses(spark)).collect()]
    assert sorted(got, key=repr) == sorted(
        [
            (1, "ISC", []),
            (2, None, ["CC-BY-NC-4.0 notice", "MIT notice"]),
            (2, None, ["CC-BY-NC-4.0 notice", "MIT notice"]),
            (3, None, []),
            (None, "MIT notice", ["MIT notice"]),
            (4, None, []),
        ],
        key=repr,
    )
    whole = license_scan(docs, known_licenses(spark), lines=False).collect()
    assert {r.license for r in whole} == {"ISC", "MIT notice", None}
    assert all(r.line_licenses == [] for r in whole)


def test_a_known_text_of_nothing_matches_nothing(make_docs, spark):
    known = known_licenses(spark, {"empty": "...", "one": "one"})
    assert {r.license for r in license_scan(make_docs([(1, ""), (2, None), (3, "!!")]), known).collect()} == {None}


def test_messy_rows(messy):
    assert len(op5(messy).collect()) == len(MESSY)
    assert op5(messy.limit(0)).collect() == []


@pytest.mark.parametrize("width", [30, 50, 60, 72, 78, 79, 80, 100, 120, 100_000])
@pytest.mark.parametrize("head", ["", "MIT License\n\nCopyright (c) 2024 Someone\n\n", "The MIT License (MIT)\nCopyright Someone Inc.\n"])
def test_line_breaks_do_not_decide_what_a_license_is(width, head):
    known = body_digest(canonical_lines(KNOWN["MIT"]))
    text = head + "\n".join(textwrap.wrap(" ".join(KNOWN["MIT"].split()), width))
    assert b"copyright holders be liable" in canonical(text)
    assert body_digest(canonical_lines(text)) == known


def test_a_line_of_license_prose_is_no_copyright_statement():
    assert canonical("COPYRIGHT HOLDERS BE LIABLE\ncopyright notice\nCopyright 2020 X\nCopyright Free Software Foundation") == (
        b"copyright holders be liable copyright notice"
    )


def test_titled_texts_are_found(make_docs, spark):
    text = "MIT License\n\nCopyright (c) 2024 Someone\n\n" + " ".join(KNOWN["MIT"].split())
    assert [r.license for r in license_scan(make_docs([(1, text)]), known_licenses(spark)).collect()] == ["MIT"]


def test_query_equals_its_sql_on_licenses(spark):
    """Whole licenses, titled, wrapped, with statements and prose that begin with 'copyright', and texts that are none."""
    heads = ["", "MIT License\n", "The ISC License\n\n© 2020 A\n", "Copyright (c) 2024 Someone\n", "Copyright notice\n", "All rights reserved\n", "c 2020\n", "c copyright x\n"]
    texts = [head + text for head in heads for text in KNOWN.values()]
    texts += [head + "\n".join(textwrap.wrap(" ".join(KNOWN["MIT"].split()), width)) for head in heads for width in (30, 60, 79, 10_000)]
    texts += ["", None, "MIT License", "copyright", "copyright by law\nx", "copyright by X\ny", "copyrights\n", KNOWN["ISC"] + " more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, op5(docs).select("doc_id", "canonical_digest", "license", "line_licenses").collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = sorted(con.execute(f"SELECT doc_id, canonical_digest, license, line_licenses FROM ({SQL})").fetchall())
    assert got == want
    found = {number: license for number, _, license, _ in got}
    assert found[len(KNOWN)] == "MIT" and found[2 * len(KNOWN) + 1] == "ISC" and found[3 * len(KNOWN)] == "MIT"
