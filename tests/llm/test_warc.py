import base64
import gzip
import hashlib
import io
import zlib
from pathlib import Path

import pytest

from finstat.llm.warc import member, op1, read_records, read_warc, record, write_warc
from tests.llm.conftest import prose

PAGES = [
    (1, "http://a/x", "<p>" + "long " * 50),
    (2, "http://b/ y\r\nX: 1", "<p>" + "long " * 50),
    (5, None, "<p>" + "long " * 50),
    (None, "http://n", "<p>" + "long " * 50),
    (3, "http://c", "short"),
    (4, "http://d", "short"),
    (6, "http://e", None),
    (7, "http://f", ""),
    (8, "http://g", "é" * 50),
    (9, "http://g", "é" * 50),
    (9, "http://g", "é" * 50),
    (10, "http://h", prose(100_000)),
    (11, "http://i", "\r\n\r\nWARC/1.1\r\n" * 20),
]


@pytest.fixture
def pages(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return frame.selectExpr("*", "1 AS digest", "2 AS first", "3 AS number", "'z' AS payload")


def test_query_equals_brute_force(pages):
    first = {}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(first.get(raw, i), i)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        to = first.get(raw)
        revisit = to is not None and i != to
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    assert sorted(map(tuple, op1(pages).collect()), key=repr) == sorted(want, key=repr)


def test_payloads_come_back(pages, tmp_path):
    folder = (tmp_path / "warc").as_uri()
    rows = read_warc(write_warc(pages, folder, archive_bytes=2000), folder).collect()
    got = sorted(bytes(r.payload) for r in rows if r.record_type == "response")
    assert set(got) == {(h or "").encode() for *_, h in PAGES}
    assert all(r.payload is None for r in rows if r.record_type == "revisit")
    assert {r.target_uri for r in rows} >= {None, "http://b/%20y%0D%0AX:%201"}
    # Every archive is a row of gzip members that any reader can inflate.
    for path in Path(tmp_path / "warc").iterdir():
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_archives_of_lost_attempts_are_not_read(pages, tmp_path):
    folder = (tmp_path / "warc").as_uri()
    manifest = write_warc(pages, folder)
    (tmp_path / "warc" / "orphan.warc.gz").write_bytes(b"left by an executor that died")
    assert read_warc(manifest, folder).count() == len(PAGES)


def rec(payload=b"payload " * 20):
    return record(1, "http://a", payload, hashlib.sha256(payload).hexdigest(), None, False, "1970-01-01T00:00:00Z")


def read(data):
    return list(read_records(io.BytesIO(data), payloads=True))


def test_reader_takes_members_apart_at_any_boundary():
    sizes = [0, 1, 65_000, 65_536, 70_000, 300_000]
    data = b"".join(member(rec(bytes([65 + i]) * n), 9 if i % 2 else 0) for i, n in enumerate(sizes))
    assert [len(r["payload"]) for r in read(data)] == sizes


@pytest.mark.parametrize(
    "data,message",
    [
        (member(rec().replace(b"payload payload", b"payload PAYLOAD", 1), 6), "block digest"),
        (member(rec(), 6)[:-30], "ends inside"),
        (member(rec() + rec(), 6), "exactly one"),
        (member(rec()[:-10], 6), "shorter|exactly one"),
        (member(b"WARC/0.9\r\n\r\n", 6), "version"),
        (member(b"WARC/1.1\r\nno end", 6), "header"),
    ],
)
def test_broken_records_raise(data, message):
    with pytest.raises(ValueError, match=message):
        read(data)


def test_members_that_are_no_gzip_raise():
    with pytest.raises(zlib.error):
        read(b"not a gzip member")


def test_empty(pages, tmp_path):
    folder = (tmp_path / "warc").as_uri()
    assert read_warc(write_warc(pages.limit(0), folder), folder).collect() == []


# --- archives of other origin, records written by hand


def by_hand(kind, block, version="WARC/1.0", **fields):
    lines = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items())]
    return member("\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6)


def http(body, *lines, status="200 OK"):
    return "\r\n".join([f"HTTP/1.1 {status}", *lines]).encode() + b"\r\n\r\n" + body


RESPONSE = {"Content_Type": "application/http; msgtype=response", "WARC_Target_URI": "http://a"}
BODY = b"<p>body"


def base32(data, algorithm="sha1"):
    return f"{algorithm}:{base64.b32encode(hashlib.new(algorithm, data).digest()).decode()}"


@pytest.mark.parametrize(
    "digest",
    [
        base32(BODY),
        base32(BODY).lower(),
        base32(BODY, "md5"),
        base32(BODY, "md5").rstrip("="),
        base32(BODY, "sha256"),
        f"sha1:{hashlib.sha1(BODY).hexdigest()}",
        f"SHA-256:{hashlib.sha256(BODY).hexdigest().upper()}",
        f"sha512:{hashlib.sha512(BODY).hexdigest()}",
        "unheard-of:anything",
    ],
)
@pytest.mark.parametrize("version", ["WARC/1.0", "WARC/1.1"])
def test_digests_by_label_and_encoding(digest, version):
    block = http(BODY, f"Content-Length: {len(BODY)}")
    (row,) = read(by_hand("response", block, version, **RESPONSE, WARC_Payload_Digest=digest, WARC_Block_Digest=base32(block)))
    assert (row["payload"], row["payload_bytes"]) == (BODY, len(BODY))
    assert row["payload_digest"] == hashlib.sha256(BODY).hexdigest()


@pytest.mark.parametrize("digest", [base32(b"other"), "sha1:", "sha1:no-digest", "sha256:00", "md5:" + "0" * 32])
def test_wrong_digests_raise(digest):
    with pytest.raises(ValueError, match="payload digest"):
        read(by_hand("response", http(BODY), **RESPONSE, WARC_Payload_Digest=digest))
    with pytest.raises(ValueError, match="block digest"):
        read(by_hand("resource", BODY, Content_Type="text/html", WARC_Block_Digest=digest))


@pytest.mark.parametrize("kind", ["resource", "warcinfo", "metadata", "conversion"])
@pytest.mark.parametrize("block", [b"", BODY, b"a: 1\r\n\r\nb: 2\r\n\r\n" * 9000])
def test_blocks_that_are_not_http_are_payload(kind, block):
    """Also without a content type; a blank line in them parts nothing."""
    for fields in ({}, {"Content_Type": "text/html", "WARC_Payload_Digest": base32(block)}):
        (row,) = read(by_hand(kind, block, **fields))
        assert (row["payload"], row["payload_bytes"]) == (block, len(block))
        assert row["payload_digest"] == hashlib.sha256(block).hexdigest()


def test_payload_bytes_are_counted():
    """A stated length that is not the payload's raises, unless the head or the record says why."""
    false = http(b"ab", "Content-Length: 9")
    with pytest.raises(ValueError, match="has 2 bytes, its head states 9"):
        read(by_hand("response", false, **RESPONSE))
    (cut,) = read(by_hand("response", false, **RESPONSE, WARC_Truncated="length"))
    (coded,) = read(by_hand("response", http(b"2\r\nab\r\n0\r\n\r\n", "Content-Length: 9", "Transfer-Encoding: chunked"), **RESPONSE))
    (unsent,) = read(by_hand("response", http(b"", "Content-Length: 9", status="304 Not Modified"), **RESPONSE))
    (silent,) = read(by_hand("response", http(b"ab"), **RESPONSE))
    (asked,) = read(by_hand("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request"))
    assert [r["payload_bytes"] for r in (cut, coded, unsent, silent, asked)] == [2, 12, 0, 2, 0]


def test_revisits_of_other_archives():
    for block in (http(b"", "Content-Length: 70"), b"HTTP/1.1 200 OK\r\nContent-Length: 70\r\n"):
        (row,) = read(by_hand("revisit", block, **RESPONSE, WARC_Payload_Digest=base32(BODY), WARC_Refers_To="<urn:uuid:7>"))
        assert (row["payload"], row["payload_bytes"], row["payload_digest"]) == (None, 70, base32(BODY))
        assert row["refers_to"] == "urn:uuid:7"
    (bare,) = read(by_hand("revisit", b""))
    assert (bare["payload_bytes"], bare["payload_digest"], bare["refers_to"]) == (None, None, None)


def test_headers_of_other_archives():
    """Lines that go on, blanks before colons, text that is no UTF-8, heads over a piece's end."""
    head = b"warc/1.0".upper() + b"\r\nWARC-Type : resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI:\r\n http://a/\xff\r\nContent-Length: 2"
    (row,) = read(member(head + b"\r\n\r\nab\r\n\r\n", 6))
    assert (row["record_type"], row["target_uri"], row["payload"]) == ("resource", "http://a/\ufffd", b"ab")
    for wide in (65_400, 65_500, 65_536, 200_000):
        (row,) = read(by_hand("response", http(BODY, "X: " + "x" * wide, f"content-length: {len(BODY)}"), **RESPONSE))
        assert row["payload"] == BODY
    with pytest.raises(ValueError, match="no Content-Length"):
        read(member(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n", 6))
