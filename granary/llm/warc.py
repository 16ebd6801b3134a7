"""WARC archives as a Spark data source, ``format("warc")``: reader with filter pushdown, and writer.

The reader plans groups of whole files as partitions (archives roll over, so files are bounded).
It parses a record's headers first and decodes its payload only if the record passes the pushed
filters. Compressed archives hold a gzip member for each record; members written here carry the
'sl' extra field with their length, so an unwanted record's payload isn't even inflated.

Files are reached through pyarrow's file systems, by the path's scheme.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from granary.llm.common import Scratch, scratch_path, spread_join, utf8

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
INDEX = "_committed.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of archives that a reading task takes, and of one archive when written.
TASK_BYTES = FILE_BYTES = 128 << 20
BATCH_BYTES = 8 << 20
READ_BYTES = 1 << 18


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """A header's value must stay on its line."""
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in value)


def record(row: Row, date: str) -> bytes:
    """One record. A revisit keeps the HTTP headers, with the payload's length, and no payload."""
    payload = bytes(row["payload"] or b"")
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date'] or date}"]
    if row["target_uri"]:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {row['refers_to']}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with the skip lengths (whole member, plain data) in its extra field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x04\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Bytes:
    """A forward reader with a buffer; ``skip`` seeks. taken: bytes read so far."""

    def __init__(self, file):
        self.file, self.buffer, self.at, self.taken = file, b"", 0, 0

    def need(self, n: int) -> bool:
        while len(self.buffer) - self.at < n:
            more = self.file.read(max(READ_BYTES, n - (len(self.buffer) - self.at)))
            if not more:
                return False
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        return True

    def take(self, n: int) -> bytes:
        self.need(n)
        out = self.buffer[self.at : self.at + n]
        self.at += len(out)
        self.taken += len(out)
        return out

    def line(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self.need(len(self.buffer) - self.at + 1):
                return self.take(len(self.buffer) - self.at)
        return self.take(end + 1 - self.at)

    def skip(self, n: int) -> None:
        have = min(n, len(self.buffer) - self.at)
        self.at += have
        if n > have:
            self.file.seek(self.file.tell() + n - have)


class _Member:
    """The plain bytes of one gzip member, inflated only as far as read."""

    def __init__(self, source: _Bytes):
        self.source, self.z, self.left = source, zlib.decompressobj(31), None
        source.need(24)
        head = source.buffer[source.at : source.at + 24]
        if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
            self.left = struct.unpack_from("<I", head, 16)[0]

    def read(self, n: int) -> bytes:
        out = b""
        while not out and not self.z.eof:
            data = self.z.unconsumed_tail
            if not data:
                if not self.source.need(1):
                    break
                data = self.source.take(min(READ_BYTES, self.left or READ_BYTES, len(self.source.buffer) - self.source.at))
                if self.left is not None:
                    self.left -= len(data)
            out = self.z.decompress(data, n)
            if self.z.eof:
                self.source.at -= len(self.z.unused_data)
                if self.left is not None:
                    self.left += len(self.z.unused_data)
        return out

    def close(self) -> None:
        """Go to the member's end: by its length where it is known, else by inflating the rest."""
        if self.z.eof:
            return
        if self.left is not None:
            self.source.skip(self.left)
            return
        while self.read(READ_BYTES):
            pass


def _headers(source: _Bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := source.line().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _records(file, compressed: bool) -> Iterator[tuple[dict[str, str], _Bytes]]:
    """Each record's headers and a reader at its block, which may be left unread."""
    raw = _Bytes(file)
    while raw.need(1):
        if compressed:
            m = _Member(raw)
            source = _Bytes(m)
        else:
            source = raw
        first = source.line()
        while first in (b"\r\n", b"\n"):
            first = source.line()
        if first:
            if not first.startswith(b"WARC/"):
                raise ValueError(f"no record where one should begin: {first[:40]!r}")
            headers = _headers(source)
            size = int(headers.get("content-length", 0))
            if compressed:
                yield headers, source
            else:
                source.need(0)
                before = file.tell() - (len(raw.buffer) - raw.at)
                yield headers, source
                raw.skip(before + size - (file.tell() - (len(raw.buffer) - raw.at)))
        if compressed:
            m.close()


_CHUNK = re.compile(rb"([0-9A-Fa-f]+)[ \t]*(?:;[^\n]*)?\r?\n")


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """A chunked body's data, and whether it came to its last chunk. A body without chunks (some crawlers undo them and keep the header) is its own data."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size, at = int(m[1], 16), m.end()
        if not size:
            return b"".join(out), True
        out.append(body[at : at + size])
        if len(out[-1]) < size:
            return b"".join(out), False
        at += size
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    return (b"".join(out), False) if out else (body, True)


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


class WarcReader(DataSourceReader):
    """Options: path; payload: decode (the default; checked against its digest), verify (checked, returned null) or skip (not inflated, but for chunked bodies, whose length only shows so)."""

    def __init__(self, options: dict):
        self.path, self.payload, self.filters = options["path"], options.get("payload", "decode"), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = file_system(self.path)
        found = [system.get_file_info(root)]
        if found[0].type == fs.FileType.Directory:
            found = system.get_file_info([f"{root}/{n}" for n in archives(system, root)])
        out, size = [], TASK_BYTES
        for i in found:
            if size >= TASK_BYTES:
                out.append(Files())
                size = 0
            out[-1].paths.append(i.path)
            size += i.size
        return out or [Files()]  # without partitions, Spark would read one of its own

    def wanted(self, values: dict[str, str | None]) -> bool:
        tests = {
            EqualTo: lambda v, f: v == f.value,
            In: lambda v, f: v in f.value,
            IsNotNull: lambda v, f: True,
            StringStartsWith: lambda v, f: v.startswith(f.value),
            StringEndsWith: lambda v, f: v.endswith(f.value),
            StringContains: lambda v, f: f.value in v,
        }
        return all((v := values[f.attribute[0]]) is not None and tests[type(f)](v, f) for f in self.filters)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((n, pa.string()) for n in _HEADERS), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        system, _ = file_system(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for headers, source in _records(file, path.endswith(".gz")):
                    values = {n: headers.get(h) for n, h in _HEADERS.items()}
                    if values["payload_digest"]:
                        values["payload_digest"] = values["payload_digest"].removeprefix("sha1:")
                    if not self.wanted(values):
                        continue
                    row = values | self._body(headers, source, values)
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _body(self, headers: dict[str, str], source: _Bytes, values: dict) -> dict:
        """The payload and its length. That of an HTTP message is the rest of the block, without chunking, or as much of it as its Content-Length says.

        A revisit's length is what its HTTP headers say, null if they don't.
        """
        size = int(headers.get("content-length", 0))
        length, payload, chunked = size, None, False
        if headers.get("content-type", "").startswith("application/http"):
            begun = source.taken
            status = source.line().split(b" ")[1:2]
            http = _headers(source)
            size = max(0, size - (source.taken - begun))
            chunked = "chunked" in http.get("transfer-encoding", "").lower()
            told = http.get("content-length", "")
            length = int(told) if told.isdecimal() and not chunked else None
            if values["record_type"] != "revisit":
                bare = not size and status in ([b"204"], [b"304"])
                length = size if length is None or bare else length
        cut = "warc-truncated" in headers
        if values["record_type"] != "revisit" and (self.payload != "skip" or chunked):
            size = size if chunked else min(size, length)
            body = source.take(size)
            payload, whole = unchunked(body) if chunked else (body, size == length)
            # Some crawlers' digests are of the body as sent, with its chunks.
            known = not values["payload_digest"] or values["payload_digest"] in (digest(payload), digest(body))
            if len(body) != size or not (whole or cut) or not known:
                raise ValueError(f"{values['record_id']}: the payload differs from its length or digest")
            length = len(payload)
        elif values["record_type"] != "revisit" and cut:
            length = min(size, length)
        return {"payload_bytes": length, "payload": payload if self.payload == "decode" else None}


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def archives(system: fs.FileSystem, root: str) -> list[str]:
    """Names of a folder's archives: those in its index, or all where it has none. A folder that isn't there has none."""
    listed = {i.base_name: i for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True))}
    if INDEX in listed:
        return json.loads(system.open_input_file(listed[INDEX].path).read())
    return sorted(n for n in listed if n.endswith((".warc", ".warc.gz")))


class WarcWriter(DataSourceWriter):
    """Each task writes files of its own name; only files named in the index at the end count, so a lost or repeated task leaves no row twice.

    Appending takes the archives that are there into the index, whoever wrote them; overwriting deletes
    them once the new index stands. Files of this job that don't count are deleted, no others.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = file_system(self.path)
        names, file, size = [], None, 0
        for row in iterator:
            if file is None:
                names.append(f"part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                file, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
            data = member(record(row, self.date))
            file.write(data)
            size += len(data)
            if size >= FILE_BYTES:
                file.close()
                file = None
        if file is not None:
            file.close()
        return Written(names)

    def _delete(self, names: list[str]) -> None:
        system, root = file_system(self.path)
        for name in names:
            if system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                system.delete_file(f"{root}/{name}")

    def _mine(self) -> list[str]:
        system, root = file_system(self.path)
        return [i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.startswith(f"part-{self.job}-")]

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        new, mine = sorted(n for m in messages if m for n in m.names), self._mine()
        before = [n for n in archives(system, root) if n not in set(mine)]
        with system.open_output_stream(f"{root}/{INDEX}", compression=None) as out:
            out.write(json.dumps(new if self.overwrite else before + new).encode())
        self._delete([n for n in mine if n not in set(new)] + (before if self.overwrite else []))

    def abort(self, messages: list[Written | None]) -> None:
        self._delete(self._mine())


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known, and filter pushdown to Python sources on, in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive(df: DataFrame, key: str, uri: str, body: str, path: str, least: int = 0) -> None:
    """Write a record for each row of ``df`` to the archives in ``path``.

    Of rows with equal payloads of at least ``least`` bytes, that with the largest ``key`` is a
    response and others are revisits of it. Rows equal in key and payload are each a response.
    A null body is empty; payloads of any length are written whole. A null key counts as smaller than any; where all keys of
    a payload are null, each row is a response. An empty table adds no record. Other columns are not looked at.
    """
    rows = df.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("target_uri"), utf8(F.col(body)).alias("payload"))
    # The first 128 bits of the digest, as two longs.
    sha = F.sha1("payload")
    rows = rows.withColumns({"k1": F.conv(F.substring(sha, 1, 16), 16, -10).cast("bigint"), "k2": F.conv(F.substring(sha, 17, 16), 16, -10).cast("bigint")})
    # Only digests of several rows are joined back; copies are counted map-side, and those of a common payload not dealt by it.
    heads = rows.filter(F.octet_length("payload") >= least).groupBy("k1", "k2").agg(F.max("key").alias("head"), F.count("*").alias("rows"))
    scratch = Scratch(df.sparkSession, "heads")
    heads = scratch.write(heads.filter("rows > 1 AND head IS NOT NULL"), "heads")
    rows = spread_join(rows, heads, ["k1", "k2"], "rows", ["key", "target_uri"])
    rows = rows.withColumn("head", F.when(F.octet_length("payload") >= least, F.col("head")))
    revisit = F.col("head").isNotNull() & ~F.col("key").eqNullSafe(F.col("head"))

    def name(c: str):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    out = rows.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), name("key").alias("record_id"), "target_uri", F.lit(None).cast("string").alias("date"), F.when(revisit, name("head")).alias("refers_to"), "payload")
    register(df.sparkSession)
    out.write.format("warc").mode("append").save(path)
    scratch.drop("heads")


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back, payloads checked against their digests."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    archive(pages, "page_id", "url", "html", path)
    rows = spark.read.format("warc").option("payload", "verify").load(path)

    def key(c: str):
        return F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) AS bigint)")

    return rows.select(key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", key("refers_to")).alias("refers_to"))


def _b32() -> str:
    """Base32 of a hex SHA-1 ``h`` in SQL: five hex digits are 20 bits are four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for i in range(0, 40, 5):
        number = f"CAST('0x' || substr(h, {i + 1}, 5) AS BIGINT)"
        out += [f"substr('{letters}', CAST(({number} >> {s}) & 31 AS BIGINT) + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(out)


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT b, max(page_id) AS head FROM p GROUP BY b)
SELECT p.page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, {_b32()} AS payload_digest,
  CASE WHEN p.page_id = g.head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> g.head THEN g.head END AS refers_to
FROM p JOIN g USING (b)
"""
