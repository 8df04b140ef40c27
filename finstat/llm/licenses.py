"""License scans: whole texts in a canonical form, looked up by digest."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstat.llm.common import or_empty, staged

# Spellings that count as the same word.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "cancelling": "canceling",
    "capitalisation": "capitalization",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "noncommercial": "non commercial",
    "sublicence": "sublicense",
    "https": "http",
}
# Punctuation becomes a blank; letters A-Z their small ones.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TABLE = bytes.maketrans(
    (PUNCTUATION + "ABCDEFGHIJKLMNOPQRSTUVWXYZ").encode(), (" " * len(PUNCTUATION) + "abcdefghijklmnopqrstuvwxyz").encode()
)
TYPOGRAPHIC = re.compile("[‐‑‒–—―‘’‚“”„«»•… ]")
LINE_BYTES = 16  # of a line's SHA-256 that are kept: 128 bits tell any number of lines apart
# A line that states a copyright, or reserves all rights, in canonical form; the words of license prose that may follow
# 'copyright' where a line happens to break before it are no holder's name.
PROSE = rb"""and|are|as|be|by law|claim|claims|disclaimer|for|grant|granted|has|have|header|headers|holder|holders|in|information|interest
|interests|is|law|laws|license|licenses|line|lines|management|may|notice|notices|of|on|or|owner|owners|ownership|patent
|permission|protection|right|rights|shall|statement|statements|that|the|this|to|trademark|treaties|treaty|under|which|with"""
COPYRIGHT = re.compile(
    rb"(?:copyright(?! (?:" + PROSE.replace(b"\n", b"") + rb")(?: |$))|\xc2\xa9|c copyright|c \d{4}|all rights reserved)(?: |$)"
)
# A line that only names the license, as stands above its text.
TITLE = re.compile(rb"(?:the )?(?:mit|x11|expat|isc|0bsd|bsd zero clause|zero clause bsd)(?: (?:mit|isc|0bsd|expat))? license(?: (?:mit|x11|isc|0bsd|expat))?$")

# Short licenses and the notices by which documents point to longer ones.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}


def canonical_lines(text: str) -> list[bytes]:
    """The lines of a text in canonical form, without blank and copyright lines."""
    lines = []
    for line in TYPOGRAPHIC.sub(" ", text).encode().translate(TABLE).split(b"\n"):
        words = [SPELLING_BYTES.get(w, w) for w in line.split()]
        joined = b" ".join(words)
        if joined and not COPYRIGHT.match(joined):
            lines.append(joined)
    return lines


SPELLING_BYTES = {k.encode(): v.encode() for k, v in SPELLINGS.items()}


def body_digest(lines: list[bytes]) -> str:
    """The digest that the known texts are looked up by: of the lines below the license's title, if they have one."""
    below = lines[1:] if len(lines) > 1 and TITLE.match(lines[0]) else lines
    return hashlib.sha256(b" ".join(below)).hexdigest()


def canonical(text: str) -> bytes:
    """Case, punctuation, white space, line breaks, copyright lines and spelling variants make no difference."""
    return b" ".join(canonical_lines(text))


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text)).hexdigest()


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """The catalogue as rows (license, license_digest); texts of one canonical form are one license."""
    first: dict[str, str] = {}
    for name, text in sorted((texts or KNOWN).items()):
        first.setdefault(body_digest(canonical_lines(text)), name)
    return spark.createDataFrame([(n, d) for d, n in first.items()], "license string, license_digest string")


def license_scan(
    docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: bool = True
) -> DataFrame:
    """One row per document: id, canonical_digest, license, line_licenses.

    ``license`` is the known license that the whole text is, with or without its title line; ``line_licenses`` are those that one
    of its lines is, sorted (with ``lines`` off: none are looked for). Both are equality joins on digests with
    ``known`` (license, license_digest), which may have any size.

    - A null text counts as empty. Empty texts, and such of copyright lines only, have the digest of nothing, which no license has.
    - Null ids and repeated rows keep their rows; where a known digest is listed twice the smaller name counts.
    - An empty table gives no rows. Other columns are not read, whatever their names.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, below, parts = [], [], []
            for text in batch.column(1):
                rows = canonical_lines(text.as_py())
                whole.append(hashlib.sha256(b" ".join(rows)).hexdigest())
                below.append(body_digest(rows))
                parts.append([hashlib.sha256(r).digest()[:LINE_BYTES] for r in dict.fromkeys(rows)] if lines else [])
            columns = [batch.column(0), pa.array(whole), pa.array(below), pa.array(parts, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "canonical_digest", "body_digest", "lines"])

    nothing = hashlib.sha256(b"").hexdigest()
    known = known.groupBy("license_digest").agg(F.min("license").alias("license"))
    known = known.filter(F.col("license_digest") != nothing)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), or_empty(text_col).alias("text"))
    scanned = texts.mapInArrow(run, "id long, canonical_digest string, body_digest string, lines array<binary>")
    if lines:
        scanned = staged(scanned, "lines")  # it is read twice
    found = scanned.join(known.withColumnRenamed("license_digest", "body_digest"), "body_digest", "left")
    if not lines:
        return found.select("id", "canonical_digest", "license", F.array().cast("array<string>").alias("line_licenses"))
    # Rows get a number, as ids may be null or repeated; few lines are licenses, so little is grouped.
    numbered = found.withColumn("row", F.struct("id", "canonical_digest", "license"))
    hits = (
        numbered.select("row", F.explode("lines").alias("line"))
        .join(known.select(F.substring(F.unhex("license_digest"), 1, LINE_BYTES).alias("line"), F.col("license").alias("line_license")), "line")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("line_license")).alias("line_licenses"))
    )
    return (
        found.select("id", "canonical_digest", "license")
        .join(
            hits.select(F.col("row.id").alias("hit_id"), F.col("row.canonical_digest").alias("hit_digest"), "line_licenses"),
            F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("canonical_digest") == F.col("hit_digest")),
            "left",
        )
        .select("id", "canonical_digest", "license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))
    )


def op5(documents: DataFrame) -> DataFrame:
    known = known_licenses(documents.sparkSession)
    scan = license_scan(documents, known).withColumnRenamed("id", "doc_id")
    return scan.withColumn("line_licenses", F.array_join("line_licenses", "; "))


def _sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    punctuation = quoted(PUNCTUATION + "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    plain = quoted(" " * len(PUNCTUATION) + "abcdefghijklmnopqrstuvwxyz")
    spellings = ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in SPELLINGS.items())
    known = ", ".join(f"({quoted(name)}, {quoted(body_digest(canonical_lines(text)))})" for name, text in KNOWN.items())
    prose, title = PROSE.replace(b"\n", b"").decode(), quoted(f"^{TITLE.pattern.decode()}")
    return rf"""
WITH known(license, license_digest) AS (VALUES {known}),
spelling AS (SELECT MAP {{{spellings}}} AS m),
cleaned AS (
  SELECT doc_id, row_number() OVER () AS r,
         string_split(translate(regexp_replace(coalesce(text, ''), '[‐‑‒–—―‘’‚“”„«»•…\x{{00a0}}]', ' ', 'g'),
                                {punctuation}, {plain}), chr(10)) AS raw
  FROM documents
), canon AS (
  SELECT doc_id, r, [l FOR l IN [
      array_to_string([coalesce(m[w], w) FOR w IN regexp_extract_all(x, '[^\x20\x09-\x0D]+')], ' ') FOR x IN raw]
    IF l <> '' AND (NOT regexp_matches(l, '^(copyright|©|c copyright|c \d{{4}}|all rights reserved)( |$)')
                    OR regexp_matches(l, '^copyright ({prose})( |$)'))] AS rows
  FROM cleaned, spelling
), bodies AS (
  SELECT doc_id, r, rows, CASE WHEN len(rows) > 1 AND regexp_matches(rows[1], {title}) THEN rows[2:] ELSE rows END AS below
  FROM canon
), hits AS (
  SELECT r, list_sort(list(DISTINCT license)) AS line_licenses
  FROM (SELECT r, sha256(unnest(rows)) AS d FROM canon) JOIN known ON d = license_digest GROUP BY r
)
SELECT doc_id, sha256(array_to_string(rows, ' ')) AS canonical_digest, license,
       coalesce(array_to_string(line_licenses, '; '), '') AS line_licenses
FROM bodies LEFT JOIN known ON sha256(array_to_string(below, ' ')) = license_digest LEFT JOIN hits USING (r)
"""


SQL = _sql()
