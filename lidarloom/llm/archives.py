"""Legacy web archives (ARC 1 and 2) converted to WARC 1.1, written, and read back."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

#: Fixed values of the formats: names of an ARC record line's fields by version, and the revisit profile.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_BYTES = 16 << 20
LEAST_REVISIT = 100
RECORDS_A_FILE = 1000
RECORD = "page_id long, url string, warc_date string, media string, kind string, payload_digest string, payload_bytes long, block_digest string, record_id string, head string, payload string"


def arc_url(url: str | None, page_id: int | None) -> str:
    """An ARC line has blanks between its fields, so those of the URL are escaped; without one the page's own name."""
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def arc_file(pages: list[tuple[int | None, str | None, bytes]], version: int, name: str, date: str) -> bytes:
    """One ARC file: the version block, then for each page a record line with the declared length and the HTTP reply."""
    about = f"{version} 0 lidarloom\n{' '.join(ARC_FIELDS[version])}\n".encode()

    def line(url: str, media: str, length: int, status: str, at: int) -> bytes:
        if version == 1:
            return f"{url} 0.0.0.0 {date} {media} {length}\n".encode()
        return f"{url} 0.0.0.0 {date} {media} {status} - - {at} {name} {length}\n".encode()

    parts = [line(f"filedesc://{name}", "text/plain", len(about), "200", 0), about, b"\n"]
    at = sum(map(len, parts))
    for page_id, url, payload in pages:
        own = b"" if page_id is None else f"X-Page-Id: {page_id}\r\n".encode()
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        record = [line(arc_url(url, page_id), "text/html", len(body), "200", at), body, b"\n"]
        at += sum(map(len, record))
        parts += record
    return b"".join(parts)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields of the record line, content) of each record but the version block, whose second line names the fields.

    Lengths are as declared, so contents may hold anything; URLs may hold blanks, since fields are counted from the
    right. A record that is cut short raises ValueError.
    """
    at, fields = 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        if end == at:  # the blank line between records
            at += 1
            continue
        n = len(fields or ARC_FIELDS[1])
        if fields is None:  # the version block's own line may be of either version
            parts = data[at:end].decode("utf-8", "replace").split(" ")
        else:
            parts = data[at:end].decode("utf-8", "replace").rsplit(" ", n - 1)
            if len(parts) != n:
                raise ValueError(f"an ARC record line of {len(parts)} fields, not {n}")
        length = int(parts[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) != length:
            raise ValueError(f"an ARC record declares {length} bytes and has {len(content)}")
        if fields is None:
            fields = ARC_FIELDS[int(content.split(b" ", 1)[0])]
        else:
            yield dict(zip(fields, parts, strict=True)), content
        at = end + 1 + length


def warc_date(arc_date: str) -> str:
    """ARC dates have 14 digits, old ones 12 or 8; the missing ones are zero."""
    d = (re.sub(r"\D", "", arc_date) + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def converted(fields: dict[str, str], content: bytes) -> dict:
    """What a WARC record needs, from an ARC record: id, timestamp, type and digests are made up from its content."""
    url, http = fields["URL"], content.startswith(b"HTTP/")
    head, gap, payload = content.partition(b"\r\n\r\n") if http else (b"", b"", content)
    digest = hashlib.sha256(payload).hexdigest()
    page = re.search(rb"(?im)^X-Page-Id: *(-?\d+)\r?$", head)
    page_id = int(page[1]) if page else None
    return {
        "page_id": page_id, "url": url, "warc_date": warc_date(fields["Archive-date"]), "media": fields["Content-type"],
        "kind": "response" if http else "resource", "payload_digest": digest, "payload_bytes": len(payload),
        "block_digest": hashlib.sha256(content).hexdigest(), "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {page_id} {digest}')}>",
        "head": (head + gap).decode("utf-8", "replace"), "payload": payload.decode("utf-8", "replace"),
    }


def write_arc(pages: DataFrame, date: str = "20200101000000") -> DataFrame:
    """(page_id, url, html) -> (name, arc): ARC files of 16 MB or so as binary values, versions 1 and 2 in turn."""

    def build(batches):
        k = 0
        for pdf in batches:
            rows, held = [], 0
            for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                payload = b"" if html is None else html.encode()
                rows.append((None if pd.isna(page_id) else int(page_id), url, payload))
                held += len(payload)
                if held >= ARC_BYTES:
                    yield pd.DataFrame({"name": [f"part-{k}.arc"], "arc": [arc_file(rows, 1 + k % 2, f"part-{k}.arc", date)]})
                    rows, held, k = [], 0, k + 1
            if rows:
                yield pd.DataFrame({"name": [f"part-{k}.arc"], "arc": [arc_file(rows, 1 + k % 2, f"part-{k}.arc", date)]})
                k += 1

    return pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(build, "name string, arc binary")


def read_arc(files: DataFrame) -> DataFrame:
    """(arc binary) -> one row for each record, ready to be a WARC record."""

    def parse(batches):
        names = [x.split()[0] for x in RECORD.split(", ")]
        for pdf in batches:
            for data in pdf["arc"]:
                rows, held = [], 0
                for fields, content in arc_records(bytes(data)):
                    rows.append(converted(fields, content))
                    held += len(content)
                    if held >= ARC_BYTES // 2:
                        yield framed(rows, names)
                        rows, held = [], 0
                if rows:
                    yield framed(rows, names)

    return files.select("arc").mapInPandas(parse, RECORD)


def framed(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to"):
        if c in out:
            out[c] = out[c].astype("Int64")
    return out


def with_revisits(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds record_type and refers_to (page and record id): equal payloads of at least `least` bytes are stored once.

    Digests are grouped first, with partial sums, so a payload that a third of all pages share is one row when the
    records meet it; that join's large side is split where it is skewed.
    """
    named = records.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    first = named.groupBy("payload_digest").agg(F.min(F.struct("page_id", "record_id", "url")).alias("__first"), F.count(F.lit(1)).alias("__n"))
    first = first.filter("__n > 1").drop("__n").withColumnRenamed("payload_digest", "__digest")
    out = records.join(first, (records["payload_digest"] == first["__digest"]) & (records["payload_bytes"] >= least), "left").drop("__digest")
    again = F.col("__first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("__first.page_id")))
    return out.withColumn("record_type", F.when(again, "revisit").otherwise(F.col("kind"))).withColumn("__first", F.when(again, F.col("__first")))


def warc_text(r: dict[str, Column] | None = None) -> Column:
    """A WARC record as text, without the two line ends that close it."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    only = lambda column: F.coalesce(column, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, "").otherwise(line("WARC-Block-Digest", F.concat(F.lit("sha256:"), "block_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        only(F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("__first.record_id")), line("WARC-Refers-To-Target-URI", F.col("__first.url")), line("X-Refers-To-Page", F.col("__first.page_id").cast("string"))))),
        line("Content-Type", F.when(F.col("kind") == "response", "application/http; msgtype=response").otherwise(F.col("media"))),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(records: DataFrame, path: str) -> None:
    """records of with_revisits -> gzipped WARC files below path; each record closes with two line ends."""
    records.select(warc_text().alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def warc_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an unzipped WARC stream, by declared lengths. One record
    is held at a time."""
    while version := file.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record in {version[:40]!r}")
        fields = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().removesuffix("\r\n").partition(": ")
            fields[name.lower()] = value
        block = file.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or file.read(4) != b"\r\n\r\n":
            raise ValueError(f"{fields['warc-record-id']} is not as long as declared")
        yield fields, block


RETURNED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, warc_date string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record below path. Lengths and digests of stored payloads are worked out again and must agree
    with the header; a revisit has those of the payload that it refers to."""

    def parse(batches):
        names = [x.split()[0] for x in RETURNED.split(", ")]
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                for fields, block in warc_records(gzip.GzipFile(fileobj=io.BytesIO(data))):
                    head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    digest, length, kind = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"]), fields["warc-type"]
                    if kind != "revisit" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, length):
                        raise ValueError(f"{fields['warc-record-id']} was changed on its way")
                    page = re.search(rb"(?im)^X-Page-Id: *(-?\d+)\r?$", head)
                    refers = fields.get("x-refers-to-page")
                    rows.append({"page_id": int(page[1]) if page else None, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None, "record_id": fields["warc-record-id"], "url": fields["warc-target-uri"], "warc_date": fields["warc-date"]})
                if rows:
                    yield framed(rows, names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RETURNED)


def convert_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) as ARC files, converted to WARC files in the shared folder, and read back: see RETURNED.

    Null html: an empty payload, type response. Null url: urn:page:<id>. Null page_id: stored, never the original of
    a revisit, returned as null. Rows that repeat the page_id of a payload's original are originals too. Empty table:
    no rows. Columns besides the three don't take part.
    """
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(with_revisits(read_arc(write_arc(pages))), path)
    return read_warc(pages.sparkSession, path)
