"""Web archives: pages as legacy ARC archives, converted to WARC files, which are read back."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import scratch

#: Payloads of so many bytes or more are stored once and revisited by their equals.
LEAST = 1000
#: Bytes of records in one ARC archive, and one record more at most; ARC archives in one WARC file.
ARC_BYTES, WARC_ARCHIVES = 4 << 20, 16
#: Duplicate digests up to which their table is broadcast (some 10 MB).
BROADCAST_HEADS = 100_000
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
# The header fields of the two ARC versions, in order.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
CAPTURED = "20240101000000"
END = "\r\n\r\n"


def write_arc(version: int, records: list[tuple[str, bytes]]) -> bytes:
    """An ARC archive of that version: its version block, then each record (URL, network document) after its header line."""
    block = f"{version} 0 lecturelake\n{' '.join(ARC_FIELDS[version])}\n".encode()
    name = f"pages-{version}.arc"
    first = {"URL": f"filedesc://{name}", "Content-type": "text/plain"}
    out, at = [], 0
    for url, body in [(first["URL"], block), *records]:
        values = {
            "URL": quote(url, safe="%/:=&?~#+!$,;'@()*[]") or "urn:none", "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": "text/html" if out else "text/plain", "Result-code": "200",
            "Checksum": hashlib.md5(body).hexdigest(), "Location": "-", "Offset": str(at), "Filename": name, "Archive-length": str(len(body)),
        }
        out += [" ".join(values[f] for f in ARC_FIELDS[version]).encode(), b"\n", body, b"\n"]
        at += sum(map(len, out[-4:]))
    return b"".join(out)


def read_arc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and network document of each record: the version block names the fields, the last of which is the
    declared length. A length beyond the archive, or a version 2 checksum that does not fit, is an error."""
    line_end = archive.index(b"\n")
    head = archive[:line_end].split(b" ")
    at = line_end + 1 + int(head[-1])
    version, names = archive[line_end + 1 : at].decode().splitlines()[:2]
    fields = names.split(" ")
    if ARC_FIELDS.get(int(version.split(" ")[0])) != tuple(fields):
        raise ValueError(f"unknown ARC version block: {version}; {names}")
    at += 1
    while at < len(archive):
        line_end = archive.index(b"\n", at)
        values = archive[at:line_end].decode().split(" ")
        if len(values) != len(fields):
            raise ValueError("an ARC header line has other fields than its version block")
        header = dict(zip(fields, values))
        start, length = line_end + 1, int(header["Archive-length"])
        body = archive[start : start + length]
        if len(body) != length or header.get("Checksum", "-") not in ("-", hashlib.md5(body).hexdigest()):
            raise ValueError("an ARC record is damaged")
        yield header, body
        at = start + length + 1


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """An identifier that depends on the page and payload alone, so that reruns and revisits name the same record."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def to_warc(header: dict[str, str], body: bytes, page_id: int | None, head: int | None) -> str:
    """The WARC record that stands for an ARC record: a revisit of page `head`, whose block is the HTTP header only, or a
    response. The two line ends after the block are left to the writer."""
    http, _, payload = body.partition(END.encode())
    digest, date = _sha1(payload), header["Archive-date"]
    block = body if head is None else http + END.encode()
    fields = {
        "WARC-Type": "response" if head is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        "WARC-Target-URI": header["URL"],
        "WARC-IP-Address": header["IP-address"],
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": _sha1(block),
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if head is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(head, digest), "X-Refers-To-Page-ID": str(head)}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n" + block.decode()


def read_warc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared lengths; a block digest that does not fit is an error."""
    at = 0
    while at < len(archive):
        end = archive.index(END.encode(), at)
        lines = archive[at:end].decode().split("\r\n")
        header = dict(x.split(": ", 1) for x in lines[1:])
        start, length = end + len(END), int(header["Content-Length"])
        block = archive[start : start + length]
        if not lines[0].startswith("WARC/") or _sha1(block) != header["WARC-Block-Digest"]:
            raise ValueError("a WARC record is damaged")
        yield header, block
        at = start + length + len(END)


def _arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages into ARC archives, version 1 and 2 by turns, each with its records' page ids and heads."""
    version, records, ids, heads, held = 1, [], [], [], 0
    schema = pa.schema([("archive", pa.binary()), ("page_ids", pa.list_(pa.int64())), ("heads", pa.list_(pa.int64()))])

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"archive": [write_arc(version, records)], "page_ids": [ids], "heads": [heads]}, schema)

    for batch in batches:
        for page_id, url, html, head in zip(*(batch.column(c) for c in ("page_id", "url", "html", "head"))):
            payload = (html.as_py() or "").encode()
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode()
            records.append((url.as_py() or "", http + payload))
            ids.append(page_id.as_py())
            heads.append(head.as_py())
            held += len(payload)
            if held >= ARC_BYTES:
                yield out()
                version, records, ids, heads, held = 3 - version, [], [], [], 0
    if records:
        yield out()


def _warcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each ARC archive as one text, which the writer ends as it ends a record."""
    for batch in batches:
        for archive, ids, heads in zip(*batch.columns):
            found = read_arc(archive.as_py())
            values = [to_warc(header, body, i, h) for (header, body), i, h in zip(found, ids.as_py(), heads.as_py(), strict=True)]
            yield pa.RecordBatch.from_pydict({"value": [END.join(values)]}, pa.schema([("value", pa.string())]))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))))
    number = lambda s: int(s) if s else None
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for header, block in read_warc(content.as_py()):
                http, _, payload = block.partition(END.encode())
                size = int(http.rpartition(b"Content-Length: ")[2])
                digest, kind = header["WARC-Payload-Digest"], header["WARC-Type"]
                if kind == "response" and (len(payload) != size or _sha1(payload) != digest):
                    raise ValueError("a WARC payload is damaged")
                digest = base64.b32decode(digest.removeprefix("sha1:")).hex()
                rows.append((number(header["X-Page-ID"]), size, digest, kind, number(header.get("X-Refers-To-Page-ID"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema.types)], schema=schema)


def with_heads(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with `head`: the largest page_id with the same payload where that is another page's and
    the payload has `least` bytes or more; else null.

    Only digests meet in the shuffle, combined beforehand; the few that occur twice are broadcast if they are few.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    large = slim.where(F.octet_length("html") >= least)
    heads = large.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "head")
    few = heads.limit(BROADCAST_HEADS + 1).count() <= BROADCAST_HEADS
    both = slim.join(F.broadcast(heads) if few else heads, "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("head"))
    return both.select("page_id", "url", "html", F.when(other, F.col("head")).alias("head"))


def write_pages(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """A WARC file set at path: each page goes through a legacy ARC archive and its conversion.

    Spark's text writer puts the two line ends that close a record after each archive's last one, so every part file is a
    WARC file; each is complete or absent if an executor is lost. A file holds the records of WARC_ARCHIVES archives,
    64 MB and as many of the largest records on top of that at most, since it is read back in one piece.
    """
    rows = with_heads(pages, least)
    arcs = rows.mapInArrow(_arcs, "archive binary, page_ids array<long>, heads array<long>")
    warcs = arcs.mapInArrow(_warcs, "value string")
    warcs.write.option("lineSep", END).option("maxRecordsPerFile", WARC_ARCHIVES).text(path)


def read_pages(spark, path: str) -> DataFrame:
    """What the WARC files at path hold: page_id, payload_bytes, payload_digest, record_type, refers_to; digests are verified."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read_back, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes pages as WARC files in the shared folder and returns what is read back from them, one row per page.

    A null html is an empty payload and a null url an empty one; rows with the largest page_id of equal payloads are
    all responses if that page_id repeats, and rows with a null page_id revisit it. Other columns are ignored; an empty
    table gives an empty result.
    """
    path = scratch(pages.sparkSession)
    write_pages(pages.select("page_id", "url", "html"), path, least)
    return read_pages(pages.sparkSession, path)


def archive_sql() -> str:
    """DuckDB SQL for archive over the view pages."""
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id < head THEN head END AS refers_to FROM h
"""
