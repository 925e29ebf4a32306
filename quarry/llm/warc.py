"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader inflates member by member with an incremental zlib decompressor, frames each
record by its Content-Length and verifies block and payload digests as bytes come in.
Archives lie in a folder that all executors share; each task writes files under names of
its own and reports those it finished, so a lost executor's leftovers are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import shared_dir, stored, tuned

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 256 << 20
_ID = "urn:quarry:page:"
_READ_BYTES = 1 << 16


def opened(uri: str, mode: str) -> BinaryIO:
    """A file in a local or shared folder, or in any store that pyarrow reaches."""
    if local := re.fullmatch(r"(?:file:(?://)?)?(/.*)", uri):
        return open(local[1], mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path, compression=None) if "w" in mode else store.open_input_stream(path, compression=None)


def made(uri: str) -> str:
    """Creates the folder ``uri``."""
    if local := re.fullmatch(r"(?:file:(?://)?)?(/.*)", uri):
        import os

        os.makedirs(local[1], exist_ok=True)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path)
    return uri


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Page:
    page_id: int | None
    url: str | None
    payload: bytes
    refers_to: int | None = None  # the response's page_id, of a revisit
    revisit: bool = False


def member(page: Page, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(page.payload), b"", b""])
    block = http if page.revisit else http + page.payload
    fields = [
        ("WARC-Type", "revisit" if page.revisit else "response"),
        ("WARC-Record-ID", f"<{_ID}{'null' if page.page_id is None else page.page_id}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(page.payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if page.url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", page.url)))
    if page.revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_ID}{page.refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + CRLF
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head) + press.compress(block) + press.compress(CRLF * 2) + press.flush()


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """For each gzip member of ``stream``, its inflated pieces; each must be read to its end."""
    rest = stream.read(_READ_BYTES)
    while rest:
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            while not inflate.eof:
                if not rest and not (rest := stream.read(_READ_BYTES)):
                    raise ValueError("the archive ends within a member")
                piece = inflate.decompress(rest, _READ_BYTES)
                rest = inflate.unconsumed_tail or inflate.unused_data
                if piece:
                    yield piece
            if not rest:
                rest = stream.read(_READ_BYTES)

        own = pieces()
        yield own
        for _ in own:
            pass


def _head(pieces: Iterator[bytes], got: bytes, what: str) -> tuple[list[str], bytes]:
    """(lines up to an empty one, bytes read beyond it)."""
    while (at := got.find(CRLF * 2)) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise ValueError(f"no end of the {what} header")
        got += piece
    return got[:at].decode().split("\r\n"), got[at + 4 :]


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def record(pieces: Iterator[bytes]) -> dict:
    """A record's fields and payload; raises ValueError where length, framing or a digest is wrong."""
    lines, got = _head(pieces, b"", "WARC")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = _fields(lines)
    length = int(fields["content-length"])
    block, payload_hash, sha = bytearray(), hashlib.sha1(), hashlib.sha1()
    while True:
        part = got[: length - len(block)]
        sha.update(part)
        block += part
        got = got[len(part) :]
        if len(block) == length:
            break
        if (piece := next(pieces, None)) is None:
            raise ValueError(f"{len(block)} bytes of {length}")
        got = piece
    for piece in pieces:
        got += piece
        if len(got) > 4:
            break
    if got != CRLF * 2:
        raise ValueError("the record doesn't end where its length says")
    shown = lambda h: f"sha1:{base64.b32encode(h.digest()).decode()}"
    if fields.get("warc-block-digest", shown(sha)) != shown(sha):
        raise ValueError("block digest differs")
    revisit = fields["warc-type"] == "revisit"
    http, _ = _head(iter(()), bytes(block[: block.find(CRLF * 2) + 4]), "HTTP")
    payload = bytes(block[block.find(CRLF * 2) + 4 :])
    payload_hash.update(payload)
    if not revisit and fields["warc-payload-digest"] != shown(payload_hash):
        raise ValueError("payload digest differs")
    number = lambda x: None if x is None or x == "null" else int(x)
    of = lambda k: fields[k].strip("<>").removeprefix(_ID) if k in fields else None
    return {
        "page_id": number(of("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "refers_to": number(of("warc-refers-to")),
        "payload": None if revisit else payload,
    }


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit): of equal payloads the largest page_id is the response.

    A null html is an empty payload. Payloads under ``min_bytes`` are all responses, and so
    are rows that repeat the largest page_id, and a group whose ids are all null; a null id
    counts as smaller than any. Payloads are equal if their SHA-256 and length are.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("key", F.concat(F.sha2("payload", 256), F.octet_length("payload").cast("string")))
    latest = pages.select("page_id", payload.alias("payload")).where(F.octet_length("payload") >= min_bytes)
    latest = latest.groupBy(F.concat(F.sha2("payload", 256), F.octet_length("payload").cast("string")).alias("key")).agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
    joined = own.join(latest.where("n > 1").select("key", "latest"), "key", "left")
    revisit = F.coalesce(F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest")), F.lit(False))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("latest")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) into archives and returns (path, records, bytes) of each, stored.

    ``folder`` must be shared by all executors; by default it is a new one in the session's
    shared folder. Other columns of ``pages`` are not archived. An empty table writes none.
    """
    spark = pages.sparkSession
    folder = made(folder or f"{shared_dir(spark)}/quarry-warc-{uuid.uuid4().hex}")
    tuned(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, path, n, size = [], None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, n, size))
                out = None

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = opened(path, "wb")
                data = member(Page(r["page_id"], r["url"], r["payload"], r["refers_to"], r["revisit"]), date)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([{"path": p, "records": k, "bytes": b} for p, k, b in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return stored(with_revisits(pages, min_bytes).mapInArrow(run, "path string, records long, bytes long"), "warc-written")


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_KINDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of ``archives`` (path): one task reads an archive from start to end.

    Raises where a member, a length or a digest is wrong. ``payload_bytes`` and
    ``payload_digest`` of a revisit are those of the payload that it stands for.
    """
    kinds = _KINDS if with_payload else pa.schema([f for f in _KINDS if f.name != "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path, "rb") as stream:
                    rows, size = [], 0
                    for pieces in members(stream):
                        rows.append(record(pieces))
                        size += len(rows[-1]["payload"] or b"") * with_payload + 200
                        if size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, kinds)

    paths = archives.select("path").repartition(max(1, archives.count()), "path")  # a fixed number: rows this small would else end up in one task
    return paths.mapInArrow(run, RECORD if with_payload else RECORD.removesuffix(", payload binary"))


#: What writing and reading ``pages`` gives, for DuckDB: base32 by 40 bits at a time.
SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), latest AS (
  SELECT body, max(page_id) AS latest FROM hashed GROUP BY body
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       translate(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 11, 10))::BIGINT, 32, 8)
              || to_base(('0x' || substr(h, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = latest OR latest IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = latest OR latest IS NULL THEN NULL ELSE latest END AS refers_to
FROM hashed JOIN latest USING (body)
"""
