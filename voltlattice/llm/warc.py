"""Legacy web archives to WARC: read ARC files of either version, write equivalent WARC records.

An ARC file begins with a version block, whose header line and declared length are followed by the
names of the fields of all later header lines. Version 1 lines have URL, IP address, archive date,
content type and length; version 2 lines also have result code, checksum, location, offset and file
name. The converter reads the version, then each record's header line and exactly as many bytes as
the line declares.

A WARC record gets an identifier derived from the archived address, date and digest (so a task that
runs again writes the same), an ISO 8601 date, a type, and SHA-1 digests of block and payload. Of
records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the largest key is the
response and the others are revisits without payload, which name its record, address and date; smaller
ones are all responses. Each archive begins with a ``warcinfo`` record.

Payloads are read in the task that writes them and are never shuffled: only digests and keys are.
Digests are counted per task before they move, so copies of one page don't meet in a task.

Cases: a null or empty page is a record with an empty payload; a null address is written as ``-``.
Of rows with equal payload and key, the last in the archives is the response and the others revisit
its key; a null key is less than all others, and revisits of it name nothing. An empty table gives no archive and an empty result. Header values are freed of
control characters; payload bytes are never changed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voltlattice.llm.common import materialize, partitions
from voltlattice.llm.token_files import _store, _Writer

REVISIT_BYTES = 1000
#: Bytes of records in one archive, before the last one.
ARCHIVE_BYTES = 16 << 20
_V1 = "URL IP-address Archive-date Content-type Archive-length"
_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_KEY = "X-Archive-Key"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The body after the HTTP headers, if the block has them."""
        return self.block.partition(b"\r\n\r\n")[2] if self.block.startswith(b"HTTP/") else self.block

    @property
    def http(self) -> dict[str, str]:
        head = self.block.partition(b"\r\n\r\n")[0] if self.block.startswith(b"HTTP/") else b""
        pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
        return {name.strip(): value.strip() for name, _, value in pairs}


def _clean(value: object) -> str:
    return "".join("%%%02X" % b if b <= 32 or b == 127 else chr(b) for b in str(value).encode()) if value is not None and value == value else "-"


def _utf8(text: str) -> bytes:
    """Bytes of a cleaned header value."""
    return text.encode("latin-1")


def arc_header(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{_V1 if version == 1 else _V2}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    if version == 2:
        line += f" 200 - - 0 {name}"
    return f"{line} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, kind: str, block: bytes, name: str, at: int) -> bytes:
    line = f"{url} 0.0.0.0 {date} {kind}"
    if version == 2:
        line += f" 200 {hashlib.md5(block).hexdigest()} - {at} {name}"
    return _utf8(f"{line} {len(block)}\n") + block + b"\n"


def read_arc(stream) -> Iterator[ArcRecord]:
    """The records of an ARC stream after its version block."""
    first = stream.readline()
    if not first:
        return
    body = stream.read(int(first.split()[-1])).split(b"\n")
    if body[0].split()[:1] not in ([b"1"], [b"2"]):
        raise ValueError("neither version 1 nor 2 of the format")
    names = body[1].decode().split()
    while line := stream.readline():
        if not line.strip():
            continue
        # An address may hold spaces; the fields after it don't.
        values = line.decode("latin-1").rstrip("\n").rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"a header line of {len(values)} fields, not {len(names)}")
        fields = dict(zip(names, values))
        block = stream.read(int(fields["Archive-length"]))
        if len(block) != int(fields["Archive-length"]):
            raise ValueError("the archive ends within a record")
        yield ArcRecord(fields, block)


def _iso(date: str) -> str:
    """An ISO 8601 date of the 14 digits of an archive date; missing digits are those of the epoch."""
    full = (date if date.isdigit() else "") + "19700101000000"[len(date) if date.isdigit() else 0:]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_id(url: str, date: str, digest: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


@dataclass
class Response:
    """What a revisit names of the response that it repeats."""

    key: str
    url: str
    date: str


def warc_info(name: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: archive converter\r\nformat: WARC File Format 1.1\r\n"
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", _iso("")),
            ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _utf8("".join(f"{n}: {v}\r\n" for n, v in head)) + b"\r\n" + block + b"\r\n\r\n"


def warc_record(record: ArcRecord, refers_to: Response | None) -> bytes:
    """The WARC record of an ARC record; ``refers_to`` is the response that a revisit repeats."""
    url, date = record.fields["URL"], _iso(record.fields["Archive-date"])
    payload = record.payload
    digest = hashlib.sha1(payload).hexdigest()
    revisit = refers_to is not None
    block = record.block[:len(record.block) - len(payload)] if revisit else record.block
    head = [
        ("WARC-Type", "revisit" if revisit else "response" if record.block.startswith(b"HTTP/") else "resource"),
        ("WARC-Record-ID", warc_id(url, date, digest, record.http.get(_KEY, ""))),
        ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", record.fields["IP-address"]),
        ("Content-Type", "application/http; msgtype=response" if record.block.startswith(b"HTTP/") else record.fields["Content-type"]),
        ("WARC-Block-Digest", _sha1(block)), ("WARC-Payload-Digest", _sha1(payload)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        named = _iso(refers_to.date)
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", warc_id(refers_to.url, named, digest, refers_to.key)),
                 ("WARC-Refers-To-Target-URI", refers_to.url), ("WARC-Refers-To-Date", named), ("X-Refers-To-Key", refers_to.key)]
    lines = "".join(f"{n}: {v}\r\n" for n, v in [*head, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + _utf8(lines) + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("latin-1").partition(":")
            headers[name.strip()] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        if _sha1(block) != headers["WARC-Block-Digest"]:
            raise ValueError("a block doesn't match its digest")
        yield headers, block


class _Members:
    """A gzip file of one member per record, as the formats ask for, read as one stream."""

    def __init__(self, raw):
        self.stream = io.BufferedReader(gzip.GzipFile(fileobj=raw, mode="rb"))

    def readline(self) -> bytes:
        return self.stream.readline()

    def read(self, n: int) -> bytes:
        return self.stream.read(n)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_arc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html",
              date: str = "20240101000000") -> DataFrame:
    """Write ``pages`` as ARC files of versions 1 and 2 in turn; the table of their names."""
    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, out, size = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            for k, address, text in zip(batch["key"], batch["url"], batch["body"]):
                if out is None:
                    version, name = 1 + (part + number) % 2, f"part-{part:06d}-{number:05d}.arc.gz"
                    out, size = _Writer(folder, name), 0
                    out.write(_member(arc_header(version, name, date)))
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{_KEY}: {k}\r\n\r\n".encode() + text.encode()
                out.write(_member(arc_record(version, _clean(address), date, "text/html", block, name, size)))
                size += len(block)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield pd.DataFrame({"name": [name]})
                    out, number = None, number + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"name": [name]})

    rows = pages.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(url).alias("url"),
                        F.coalesce(F.col(body), F.lit("")).alias("body"))
    return materialize(rows.mapInPandas(written, "name string"), "arc-names")


def _records(folder: str, name: str, reader) -> Iterator:
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/{name}", compression=None) as raw:
        yield from reader(_Members(raw))


def _spread(names: DataFrame) -> DataFrame:
    """The archives dealt to the session's number of partitions.

    With an explicit number, short lists of names aren't merged into one task; by a hash of the name, not the
    name, the deal isn't taken for that of a join before it, which would be merged.
    """
    return names.repartition(partitions(names.sparkSession), F.xxhash64("name"))


def _read_back(folder: str, reader, told, schema: str, names: DataFrame) -> DataFrame:
    """Rows ``told(name, number, record)`` of all records of the named archives."""
    columns = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["name"]:
                records = enumerate(_records(folder, name, reader))
                while some := list(itertools.islice(records, 500)):
                    yield pd.DataFrame([row for n, r in some if (row := told(name, n, r)) is not None], columns=columns)

    return _spread(names).mapInPandas(read, schema)


def _arc_row(name: str, n: int, record: ArcRecord) -> tuple:
    payload = record.payload
    return name, n, record.http.get(_KEY, ""), hashlib.sha1(payload).hexdigest(), len(payload), record.fields["URL"], record.fields["Archive-date"]


def convert(names: DataFrame, arc_folder: str, warc_folder: str, key_type: str = "long",
            revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Convert the named ARC files to WARC files; the table of their names. Keys compare as ``key_type``."""
    rows = materialize(_read_back(arc_folder, read_arc, _arc_row, "name string, number long, key string, digest string, bytes long, url string, date string", names), "arc-records")
    place = F.struct(F.col("key").try_cast(key_type).alias("k"), "name", "number", "key", "url", "date")
    large = rows.filter(F.col("bytes") >= revisit_bytes)
    responses = large.groupBy("digest").agg(F.max(place).alias("kept"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    revisits = (large.join(responses, "digest").filter("name != kept.name OR number != kept.number")
                .groupBy("name").agg(F.collect_list(F.struct("number", "kept.key", "kept.url", "kept.date")).alias("revisits")))

    def converted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, told in zip(batch["name"], batch["revisits"]):
                refers = {r["number"]: Response(r["key"], r["url"], r["date"]) for r in told} if told is not None else {}
                target = name.replace(".arc.", ".warc.")
                out = _Writer(warc_folder, target)
                out.write(_member(warc_info(target)))
                for n, record in enumerate(_records(arc_folder, name, read_arc)):
                    out.write(_member(warc_record(record, refers.get(n))))
                out.close()
                yield pd.DataFrame({"name": [target]})

    return materialize(_spread(names.join(revisits, "name", "left")).mapInPandas(converted, "name string"), "warc-names")


def _warc_row(_: str, __: int, record: tuple[dict[str, str], bytes]) -> tuple | None:
    headers, block = record
    if headers["WARC-Type"] == "warcinfo":
        return None
    http = ArcRecord({}, block)
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = headers["WARC-Type"] == "revisit"
    payload = None if revisit else http.payload
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't match its digest")
    size = int(headers["X-Payload-Length"]) if revisit else len(payload)
    return http.http.get(_KEY, ""), headers["WARC-Target-URI"], headers["WARC-Type"], digest, size, headers.get("X-Refers-To-Key"), payload


def read_archives(names: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(key, url, record_type, payload_digest, payload_bytes, refers_to, payload) of all records of the named WARC files.

    The digest and length of a revisit are those of the full payload it stands for. Without ``payloads``
    they are checked where they are read and not sent on.
    """
    schema = "key string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string"
    if payloads:
        return _read_back(folder, read_warc, _warc_row, f"{schema}, payload binary", names)
    return _read_back(folder, read_warc, lambda *told: row[:-1] if (row := _warc_row(*told)) else None, schema, names)
