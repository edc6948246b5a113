"""Legacy web archives (ARC) converted to WARC, and WARC files read back.

An ARC file starts with a version block, ``filedesc://...``, whose body names the version (1 or 2) and the fields of
the header lines that follow. Each document is a header line and as many bytes as the line declares; nothing in the
bytes themselves says where they end. The converter reads either version's lines and synthesises the WARC record
that a crawler would have written: an identifier made from what identifies the capture, a timestamp in ISO form, the
type, and SHA-1 digests. Of captures with equal payloads one is the response and the others revisit it.

What a legacy file holds of a page fetched by HTTP starts with the response's own header; that header is kept, and the
payload is what follows it. Where there is none, one is made. What was not fetched by HTTP (dns:, ftp:) is a resource of
its own type, and the version block becomes a warcinfo record.

Header lines are read from the right, as addresses and types may hold blanks. A date that stops early is completed with
the first instant that it may mean. A line that cannot be read, a date that is none, a body that is cut off: such a capture is
put aside with its place and the reason, and reading goes on at the next line that is a header.

Archives are sequences of gzip members, one for each record. A task packs records into files by their bytes, and each
file is one row of Spark's text sink. So any file system that Spark knows will do, and a task that is run twice leaves
one file. Files are read back a member at a time, and parsed by declared lengths.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import scratch, written

# Fields of the header lines of both ARC versions, and their version blocks' numbers.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC = b"WARC/1.1"
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public one for URLs


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Capture:
    url: str
    ip: str
    date: str  # fourteen digits
    mime: str
    payload: bytes
    status: str = "200"
    head: bytes = b""  # the HTTP response's own header, its blank line included
    kind: str = "response"  # or resource, or warcinfo


@dataclass
class Damage:
    """What of a file could not be read."""

    offset: int
    n_bytes: int
    reason: str


def _plain(value: str, empty: str = "-") -> str:
    """A header value with its blanks percent-encoded, as ARC lines are split at blanks."""
    return re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value) or empty


def arc_file(captures: list[Capture], version: int = 1, name: str = "legacy.arc") -> bytes:
    """An ARC file of that version."""
    body = f"{version} 0 gleaner\n{ARC_NAMES[version]}\n\n".encode()
    out = [_arc_line(Capture(f"filedesc://{name}", "0.0.0.0", "19960923142103", "text/plain", body), version, 0, name), body]
    at = sum(map(len, out))
    for c in captures:
        new = [_arc_line(c, version, at, name), c.head, c.payload, b"\n"]
        at += sum(map(len, new))
        out += new
    return b"".join(out)


def _arc_line(c: Capture, version: int, offset: int, name: str) -> bytes:
    fields = [_plain(c.url), c.ip, c.date, _plain(c.mime)]
    if version == 2:
        fields += [c.status, base32_sha1(c.head + c.payload), "-", str(offset), name]
    return (" ".join([*fields, str(len(c.head) + len(c.payload))]) + "\n").encode()


_HTTP = re.compile(rb"HTTP/[0-9.]+ +([0-9]{3})[^\n]*\n(?:[^\r\n][^\n]*\n)*\r?\n")
# the address and the type may hold blanks, what stands between them and behind them does not
_START = r"(?P<url>.*) (?P<ip>[0-9.]+|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*|-) (?P<date>[0-9]+) (?P<mime>[^\s;]*(?:;.*?)?)"
_LINES = {
    1: re.compile(_START + r" (?P<length>[0-9]+)"),
    2: re.compile(_START + r" (?P<status>[0-9]{3}|-) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>[0-9]+|-) (?P<filename>\S+) (?P<length>[0-9]+)"),
}
#: Bytes of a header line at most.
LINE = 1 << 16
_FIRST = "00000101000000"


def full_date(date: str) -> str:
    """Fourteen digits: of more the first, of fewer, four at least, the first instant that they may mean; ValueError if it is no date."""
    if len(date) < 4 or len(date) % 2 and len(date) < 14:
        raise ValueError(f"no date: {date}")
    found = (date + _FIRST[len(date) :])[:14]
    try:
        datetime.strptime(found, "%Y%m%d%H%M%S")  # noqa: DTZ007
    except ValueError:
        raise ValueError(f"no date: {date}") from None
    return found


def _header(line: bytes, version: int | None) -> dict[str, str] | None:
    """The fields of a header line of that version, of either if it is unknown; None if it is none."""
    text = line.rstrip(b"\r\n").decode("utf-8", "replace")
    for v in (version,) if version in _LINES else (2, 1):
        if line.endswith(b"\n") and (found := _LINES[v].fullmatch(text)):
            return found.groupdict()
    return None


def _capture(of: dict[str, str], body: bytes) -> Capture:
    url, date = "" if of["url"] == "-" else of["url"], full_date(of["date"])
    if not re.match(r"https?:", url, re.I) and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", url):
        return Capture(url, of["ip"], date, of["mime"], body, of.get("status") or "200", b"", "resource")
    found = _HTTP.match(body)
    head = found[0] if found else b""
    status = of.get("status") or (found[1].decode() if found else "200")
    return Capture(url, of["ip"], date, of["mime"], body[len(head) :], status, head)


def _version_block(of: dict[str, str], body: bytes, version: int) -> Capture:
    """A warcinfo record's fields, from the version block: the file's name, the version, and who wrote it."""
    words = body.split(b"\n", 1)[0].decode("utf-8", "replace").split(" ", 2)
    name = of["url"].removeprefix("filedesc:").lstrip("/")
    lines = {"software": "gleaner", "format": "WARC File Format 1.1", "description": f"converted from ARC version {version}", "isPartOf": name, "publisher": words[2].strip() if len(words) > 2 else ""}
    text = "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v)
    return Capture(of["url"], of["ip"], full_date(of["date"]), "application/warc-fields", text.encode(), "", b"", "warcinfo")


def scan_arc(file: BinaryIO) -> Iterator[Capture | Damage]:
    """All of an ARC file of either version in order, its version blocks too, and what of it is damaged; one capture is held at a time."""
    at, version, first, lost, fresh = 0, None, True, None, True

    def found_again() -> Iterator[Damage]:
        nonlocal lost
        if lost is not None:
            yield Damage(lost[0], at - lost[0], lost[1])
            lost = None

    try:
        while line := file.readline(LINE):
            start = at
            if not line.strip(b"\r\n"):
                at, fresh = at + len(line), True
                continue
            # a file begins with a version block; one that is glued to another has a second
            block = line.startswith(b"filedesc:")
            of = _header(line, None if block or first else version) if fresh else None  # else a body is longer than it declares
            if of is None:
                lost = lost or (start, f"no header line: {line[:80]!r}")
                at, first, fresh = at + len(line), False, line.endswith(b"\n")
                continue
            yield from found_again()
            at += len(line)
            n = int(of["length"])
            body = file.read(n)
            at, fresh = at + len(body), not body or body.endswith(b"\n")
            if len(body) < n:
                yield Damage(start, at - start, f"{n} bytes declared, {len(body)} left")
                return
            try:
                if block:
                    number = body.split(b" ", 1)[0].strip()
                    version = int(number) if number in (b"1", b"2") else None
                    if version is None or _header(line, version) is None:
                        raise ValueError("the version block declares another version than its own line has")
                    yield _version_block(of, body, version)
                else:
                    if first:
                        yield Damage(start, 0, "no version block")
                    yield _capture(of, body)
            except ValueError as e:
                yield Damage(start, at - start, str(e))
            first = False
        yield from found_again()
    except (OSError, EOFError, zlib.error) as e:
        yield from found_again()
        yield Damage(at, 0, f"cannot be unpacked: {e}")


def read_arc(data: bytes | BinaryIO) -> Iterator[Capture]:
    """The captures of a sound ARC file of either version, by its own version block and the lengths its lines declare; ValueError at what is damaged."""
    for c in scan_arc(io.BytesIO(data) if isinstance(data, bytes) else data):
        if isinstance(c, Damage):
            raise ValueError(f"at {c.offset}: {c.reason}")
        if c.kind != "warcinfo":
            yield c


def record_id(url: str, date: str, number: object) -> str:
    """The same capture gets the same identifier, whoever converts it; equal rows are one capture."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{date} {number} {url}')}>"


def warc_record(c: Capture, number: object, refers_to: object = None, refers_url: str = "", refers_date: str = "") -> bytes:
    """The capture as a WARC record without its last two line ends: of its own kind, or a revisit of the capture referred to."""
    revisit = refers_to is not None
    day = f"{c.date[:4]}-{c.date[4:6]}-{c.date[6:8]}T{c.date[8:10]}:{c.date[10:12]}:{c.date[12:14]}Z"
    digest = base32_sha1(c.payload)
    http, kind = b"", c.mime or "application/octet-stream"
    if c.kind == "response":
        http = c.head or f"HTTP/1.1 {c.status} OK\r\nContent-Type: {c.mime}\r\nContent-Length: {len(c.payload)}\r\n\r\n".encode()
        kind = "application/http; msgtype=response"
    block = http if revisit else http + c.payload
    head = [
        ("WARC-Type", "revisit" if revisit else c.kind),
        ("WARC-Record-ID", record_id(c.url, c.date, number)),
        ("WARC-Date", day),
        *([("WARC-Filename", c.url.removeprefix("filedesc:").lstrip("/"))] if c.kind == "warcinfo" else [("WARC-Target-URI", c.url), ("WARC-IP-Address", c.ip)]),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", kind),
        ("Content-Length", str(len(block))),
        ("Gleaner-Number", str(number)),
        ("Gleaner-Payload-Length", str(len(c.payload))),
        ("Gleaner-Head-Length", str(len(http))),
    ]
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_url, refers_date, refers_to)), ("Gleaner-Refers-To", str(refers_to))]
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in head)
    return WARC + b"\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by declared lengths; block digests are checked."""
    at = 0
    while at < len(data):
        if data[at : at + len(WARC)] != WARC:
            raise ValueError(f"no record at {at}: {data[at : at + 20]!r}")
        stop = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:])
        head = {k.lower(): v for k, v in head.items()}
        n = int(head["content-length"])
        block = data[stop + 4 : stop + 4 + n]
        if len(block) != n or data[stop + 4 + n : stop + 8 + n] != END:
            raise ValueError(f"the record at {at} is cut off")
        if head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"the record at {at} is damaged")
        yield head, block
        at = stop + 8 + n


#: A gzip member that holds nothing ends each file: the text sink ends a row with a line separator, and this one is of the format.
EMPTY = gzip.compress(b"", mtime=0)


def _members(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """What each gzip member of the data holds, one at a time."""
    at = 0
    while at < len(data):
        inflate, out = zlib.decompressobj(31), []
        while at < len(data) and not inflate.eof:
            out.append(inflate.decompress(data[at : at + size]))
            at = min(at + size, len(data))
        if not inflate.eof:
            raise ValueError("an archive is cut off")
        at -= len(inflate.unused_data)
        yield b"".join(out)


def _files(records: Iterator[bytes], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole files: records, compressed one by one, of about file_bytes together before compression; a larger record is a file of its own."""
    held, n = [], 0
    for record in records:
        if held and n + len(record) > file_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.large_binary())], ["file"])
            held, n = [], 0
        held.append(gzip.compress(record + END, 6, mtime=0))
        n += len(record)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.large_binary())], ["file"])


def _legacy(rows: list[tuple[dict, Capture]], version: int) -> Iterator[bytes]:
    """WARC records of captures: what a row says goes in in its legacy form, through an ARC file of that version, and comes out converted; what came from such a file stays as it was read."""
    through = iter(read_arc(arc_file([c for r, c in rows if not r["read"]], version)))
    for r, c in rows:
        c = c if r["read"] else next(through)
        revisit = r["refers_to"] if r["refers_to"] is not None and r["refers_to"] != r["number"] else None
        yield warc_record(c, r["number"], revisit, r["refers_url"] or "", r["refers_date"] or c.date)


def _converted(file_bytes: int):
    def captures(batches) -> Iterator[tuple[dict, Capture]]:
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):  # a row at a time, as a batch of large payloads is held once already
                r = {c: x[i].as_py() for c, x in columns.items()}
                yield r, Capture(r["url"] or "", r["ip"], r["date"], r["mime"], r["payload"] or b"", r["status"], r["head"] or b"", r["kind"])

    def records(batches) -> Iterator[bytes]:
        held, n, version = [], 0, 1
        for r, c in captures(batches):
            held.append((r, c))
            n += len(c.payload)
            if n >= file_bytes // 4 or len(held) == 1000:
                yield from _legacy(held, version)
                held, n, version = [], 0, 3 - version
        if held:
            yield from _legacy(held, version)

    return lambda batches: _files(records(batches), file_bytes)


CAPTURES = "number string, url string, ip string, date string, mime string, status string, head binary, payload binary, kind string, read boolean"
DAMAGE = "file string, offset long, n_bytes long, reason string"


def _write(captures: DataFrame, path: str, least: int, file_bytes: int) -> None:
    """Captures as WARC files. Of responses with equal payloads of least bytes or more those with the largest number stay so, and the others revisit one of them.

    Payloads meet the winners of their digest in an equi-join with a written table, which adaptive execution splits
    where a payload is very common.
    """
    size = F.octet_length("payload")
    digest = F.when((size >= least) & (F.col("kind") == "response"), F.sha1("payload"))
    winners = captures.select(digest.alias("digest"), size.alias("n"), "number", "url", "date").where("digest is not null").groupBy("digest", "n")
    winners = winners.agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("number", "url", "date")).alias("w")).where("copies > 1")
    winners = written(winners.select("digest", "n", F.col("w.number").alias("refers_to"), F.col("w.url").alias("refers_url"), F.col("w.date").alias("refers_date")), "winners")
    both = captures.withColumn("digest", digest).withColumn("n", size).join(winners, ["digest", "n"], "left").drop("digest", "n")
    files = both.mapInArrow(_converted(file_bytes), "file binary")
    # cast to a string keeps the bytes, and the sink writes them as they are
    files.select(F.col("file").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option(
        "maxRecordsPerFile", 1
    ).text(path)


def convert(pages: DataFrame, path: str, least: int = 0, file_bytes: int = 16 << 20, date: str = "20240101000000") -> None:
    """Write a WARC record for each row of pages (page_id, url, html) below path, in files of about file_bytes before compression.

    The payload is html in UTF-8 (null: empty), behind the header of an HTTP response. Of rows with equal payloads of
    least bytes or more the one with the largest page_id is a response, the others revisit it; smaller ones are
    responses. Rows that share the largest page_id are all responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    _write(pages.select(
        F.col("page_id").cast("long").alias("number"), F.col("url").cast("string").alias("url"), F.lit("0.0.0.0").alias("ip"), F.lit(date).alias("date"),
        F.lit("text/html").alias("mime"), F.lit("200").alias("status"), head.cast("binary").alias("head"), html.alias("payload"),
        F.lit("response").alias("kind"), F.lit(False).alias("read"),
    ), path, least, file_bytes)


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """What the ARC files at or below path (.arc, or .arc.gz of one or more members) hold: a row for each capture and version block, numbered by file and place, and for each damaged part.

    Captures have the columns of CAPTURES, and damaged parts those of DAMAGE; the others are null. A file is read by
    one task, a capture at a time; files of over 2 GB, twenty times what crawlers wrote, are refused by the reader of whole files.
    """
    names = [x.split()[0] for x in f"{CAPTURES}, {DAMAGE}".split(", ")]
    kinds = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in f"{CAPTURES}, {DAMAGE}".split(", ")]

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                data, name = data.as_py(), name.as_py().rsplit("/", 1)[-1]
                file = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
                for i, c in enumerate(scan_arc(file)):
                    if isinstance(c, Damage):
                        row = (*[None] * 10, name, c.offset, c.n_bytes, c.reason)
                    else:
                        row = (f"{name}#{i:010d}", c.url, c.ip, c.date, c.mime, c.status, c.head, c.payload, c.kind, True, *[None] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{arc,arc.gz}").load(path)
    return files.select("path", "content").mapInArrow(run, f"{CAPTURES}, {DAMAGE}")


def convert_arcs(spark: SparkSession, path: str, out: str, least: int = 0, file_bytes: int = 16 << 20) -> DataFrame:
    """Convert the ARC files at or below path to WARC files below out; responses with equal payloads revisit the one that is last by file and place.

    Returns what could not be converted: file, offset, n_bytes and reason of each damaged part.
    """
    found = written(read_arcs(spark, path), "arcs")
    names = [[x.split()[0] for x in schema.split(", ")] for schema in (CAPTURES, DAMAGE)]
    _write(found.where("reason is null").select(*names[0]), out, least, file_bytes)
    return found.where("reason is not null").select(*names[1])


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, name string, date string"


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """A row for each capture in the archives below path (each record but warcinfo): page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id, name, date.

    name is what the record was numbered by, and page_id and refers_to are such numbers, null where they are none.
    """

    def row(head: dict[str, str], block: bytes) -> tuple:
        payload = block[int(head["gleaner-head-length"]) :]
        number = lambda x: int(x) if x is not None and re.fullmatch(r"-?[0-9]+", x) else None
        n, digest = int(head["gleaner-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] != "revisit" and (len(payload) != n or base32_sha1(payload) != digest):
            raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
        name = head["gleaner-number"]
        return (number(name), n, digest, head["warc-type"], number(head.get("gleaner-refers-to")), head["warc-target-uri"], head["warc-record-id"], name, head["warc-date"])

    def run(batches):
        names, kinds = zip(*(x.split() for x in READ.split(", ")), strict=True)
        for batch in batches:
            for data in batch.column("content"):
                out = [row(head, block) for member in _members(data.as_py()) for head, block in read_warc(member) if head["warc-type"] != "warcinfo"]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, READ)


def archive(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Convert pages (page_id, url, html) to WARC files, in the shared folder unless a path is given, and read them back.

    A null html is an empty payload; a null url an empty address; rows with one page_id are separate captures, and those
    that share the largest of equal payloads are all responses; a null page_id never wins while a copy has one; a page
    larger than a file is a file of its own; other columns are ignored; an empty table gives no rows.
    """
    path = path or scratch(pages.sparkSession, "warc")
    convert(pages, path, least)
    return read_back(pages.sparkSession, path)
