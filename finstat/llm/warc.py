"""WARC archives: a writer with revisit records, and a sequential reader."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstat.llm.common import or_empty, staged
from finstat.session import staging_path

CHUNK = 1 << 16
# Fixed values of the format.
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", VERSION)
ALGORITHMS = {"md5": "md5", "sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha512": "sha512", "sha-512": "sha512"}
NO_BODY = (b"1", b"204", b"304")  # how the status of an HTTP response begins that has no body, whatever length it states
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
RECORD_URN = "urn:x-record:"


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", uri)))


# --- writing


def record(
    number: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, date: str
) -> bytes:
    """One record, uncompressed: an HTTP response, or a revisit that keeps its headers only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload)
    block = head + END + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{RECORD_URN}{'' if number is None else number}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Refers-To", f"<{RECORD_URN}{first}>" if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = [VERSION, *(f"{name}: {value}".encode() for name, value in fields if value is not None)]
    return b"\r\n".join(lines) + END + block + END


def member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 100,
    archive_bytes: int = 256 << 20,
    level: int = 6,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row into archives in ``folder``; returns the manifest (path, records, bytes).

    Of rows whose payloads are equal and have at least ``least_bytes``, the one with the smallest
    id is a response and the others are revisits of it; all other rows are responses.
    Each record is a gzip member of its own. A task writes its archives under names that
    no other attempt uses, and only those of the attempts that Spark commits are in the
    manifest, so lost executors and speculative copies leave no double records.

    - A null payload is empty. A null url leaves the field out.
    - A row with a null id is never what others refer to, unless all ids of its group are null:
      then all are responses.
    - Rows repeated with the response's id are responses, too.
    - An empty table gives an empty manifest. Other columns are not read, whatever their names.
    """
    payload = or_empty(F.col(payload_col).cast("string"))
    rows = pages.select(
        F.col(id_col).cast("long").alias("number"),
        F.col(url_col).alias("url"),
        payload.cast("binary").alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    firsts = (
        rows.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        out, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{uuid.uuid4().hex}.warc.gz"
                    out, count = fs.open_output_stream(f"{root}/{path}", compression=None), 0
                first = row["first"]
                revisit = first is not None and row["number"] != first
                args = (row["number"], row["url"], row["payload"], row["digest"], first, revisit, date)
                out.write(member(record(*args), level))
                count += 1
                if out.tell() >= archive_bytes:
                    done.append((path, count, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((path, count, out.tell()))
            out.close()
        if done:
            columns = [pa.array(c) for c in zip(*done, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "records", "bytes"])

    manifest = rows.join(firsts, "digest", "left").select("number", "url", "payload", "digest", "first")
    return staged(manifest.mapInArrow(write, "path string, records long, bytes long"), "manifest")


# --- reading


class Member:
    """One gzip member of a stream, inflated as it is read."""

    def __init__(self, stream: BinaryIO, ahead: bytes) -> None:
        self.stream, self.ahead = stream, ahead
        self.inflate = zlib.decompressobj(31)
        self.held = b""

    def _more(self) -> bool:
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.ahead or self.stream.read(CHUNK)
            self.ahead = b""
            if not data:
                raise ValueError("the archive ends inside a record")
            if out := self.inflate.decompress(data, CHUNK):
                self.held += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                raise ValueError("a record's header does not end")
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.held and not self._more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.held = self.held[:length], self.held[length:]
            length -= len(piece)
            yield piece

    def close(self) -> bytes:
        """Check that the record ends where the member does; what was read beyond it."""
        if b"".join(self.take(len(END))) != END or self.held or self._more():
            raise ValueError("a gzip member does not hold exactly one record")
        return self.inflate.unused_data


class Stated:
    """A digest field, ``label:value``: the value in hex or base32, upper or lower case.

    Labels that this reader does not know are not verified.
    """

    def __init__(self, field: str | None) -> None:
        label, _, self.value = (field or "").partition(":")
        self.name = ALGORITHMS.get(label.strip().lower())
        self.hash = hashlib.new(self.name) if self.name else None

    def update(self, data: bytes) -> None:
        if self.hash:
            self.hash.update(data)

    def bytes(self) -> bytes | None:
        """The stated digest; None if the value is of neither form."""
        # Padded base32 of MD5 is as long as its hex form.
        value, size = self.value.strip().rstrip("="), hashlib.new(self.name).digest_size
        try:
            if len(value) == 2 * size:
                return bytes.fromhex(value)
            return base64.b32decode(value + "=" * (-len(value) % 8), casefold=True)
        except (ValueError, binascii.Error):
            return None

    def check(self, what: str, of: str) -> None:
        if self.hash and self.bytes() != self.hash.digest():
            raise ValueError(f"{what} digest of {of} does not match")


def header_fields(lines: list[bytes]) -> dict[str, str]:
    """Names in lower case; a line that begins with a blank goes on with the one before."""
    joined: list[str] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and joined:
            joined[-1] += " " + text.strip()
        else:
            joined.append(text)
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in joined)}


def read_records(stream: BinaryIO, payloads: bool) -> Iterator[dict]:
    """The records of an archive, one after the other, each verified against its digests.

    Records of WARC 1.0 and 1.1, one gzip member each, of any type. The payload of an HTTP block is what follows its
    head; of any other block, all of it; a revisit has none. ``payload_bytes`` counts it, for a revisit it is what the HTTP
    head states. A whole HTTP response whose payload is not as long as its head states raises; transfer-coded ones
    and those marked as truncated are taken as they lie in the record. ``payload_digest`` is the SHA-256 of
    the payload in hex; of a revisit, whose payload is elsewhere, the stated SHA-256 in hex or else the field as it stands.
    """
    ahead = stream.read(CHUNK)
    while ahead:
        part = Member(stream, ahead)
        lines = part.until(END).split(b"\r\n")
        if lines[0] not in VERSIONS:
            raise ValueError(f"not a record of a known version: {lines[0][:20]!r}")
        fields = header_fields(lines[1:])
        name, kind = fields.get("warc-record-id", "").strip("<> "), fields.get("warc-type", "")
        if not fields.get("content-length", "").isdecimal():
            raise ValueError(f"{name or 'a record'} has no Content-Length")
        block, stated = Stated(fields.get("warc-block-digest")), Stated(fields.get("warc-payload-digest"))
        payload, head, kept, size = hashlib.sha256(), bytearray(), [], 0
        revisit = kind == "revisit"
        http = in_head = fields.get("content-type", "").lower().startswith("application/http")
        for piece in part.take(int(fields["content-length"])):
            block.update(piece)
            if in_head:
                seen = max(0, len(head) - len(END) + 1)
                head += piece
                if (at := head.find(END, seen)) < 0:
                    continue
                in_head, piece = False, bytes(head[at + len(END) :])
                del head[at:]
            if revisit:
                continue
            size += len(piece)
            payload.update(piece)
            stated.update(piece)
            if payloads:
                kept.append(piece)
        block.check("block", name)
        first, *rest = bytes(head).split(b"\r\n")
        of_head = header_fields(rest) if http else {}
        length = of_head.get("content-length", "")
        length = int(length) if length.isdecimal() else None
        if revisit:
            whole = stated.bytes().hex() if stated.name == "sha256" and stated.bytes() else fields.get("warc-payload-digest")
        else:
            stated.check("payload", name)
            whole = payload.hexdigest()
            status = first.split(b" ")[1] if first.startswith(b"HTTP/") and b" " in first else b""
            apart = "warc-truncated" in fields or "transfer-encoding" in of_head or status.startswith(NO_BODY)
            if kind == "response" and length is not None and length != size and not apart:
                raise ValueError(f"the payload of {name} has {size} bytes, its head states {length}")
        yield {
            "record_id": name,
            "record_type": kind,
            "target_uri": fields.get("warc-target-uri"),
            "refers_to": fields.get("warc-refers-to", "").strip("<> ") or None,
            "payload_bytes": length if revisit else size,
            "payload_digest": whole,
            "payload": b"".join(kept) if payloads and not revisit else None,
        }
        ahead = part.close() or stream.read(CHUNK)


SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """The records of the archives that ``manifest`` names; several archives are read at a time.

    An archive is read from start to end in one task, in pieces of 64 KB: a reader holds a
    piece, a header and, if asked for, the payloads of one batch. A record that is cut
    short, has another length than stated or fails a digest raises. No archives, no rows.
    """
    fields = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
                        ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("payload", pa.binary())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for row in read_records(stream, payloads):
                        rows.append(row)
                        size += 500 + len(row["payload"] or b"")
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=fields)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    archives = max(1, manifest.count())
    return manifest.select("path").repartition(archives).mapInArrow(read, SCHEMA)


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


def op1(pages: DataFrame) -> DataFrame:
    folder = staging_path(pages.sparkSession, "warc")
    records = read_warc(write_warc(pages, folder), folder, payloads=False)

    def number(column: str):
        return F.expr(f"try_cast(nullif(substring({column}, {len(RECORD_URN) + 1}), '') AS BIGINT)")

    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )
