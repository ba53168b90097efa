"""WARC archives as a PySpark Python data source, and the archive job on it.

Reading: ``spark.read.format("warc").option("payload", "true").load(path)`` has
one row for each record: record_type, page_id (long, from the record id; null if
that holds none), url, refers_to (page_id of the record a revisit points to),
payload_digest, payload_length (long), file, and payload (binary) if option
``payload`` is true.

  * *Planning.* Files of the archive (the committed ones that ``_files`` lists, or
    all ``*.warc`` and ``*.warc.gz`` under the path) are planned into partitions of
    about ``partition_bytes``; a partition reads its files as streams with seeks.
  * *Pushdown.* Equality, ``IN``, null tests and comparisons on record_type and on
    the columns from headers are pushed down, and are decided on the headers.
  * *Headers first.* Of every record only the header block is inflated and
    parsed. If the record is not wanted, or no payload is, the reader seeks to the
    next record: over Content-Length in plain files, and in compressed ones (one
    gzip member for each record) over the member's length, which the writer puts
    in the member's extra field ``SL``. Members of other writers lack it and are
    inflated through.

Writing: ``df.write.format("warc").mode("append").save(path)`` takes columns
record_type, page_id, url, refers_to, payload_digest, payload_length, payload.
Each attempt of a task writes a file of its own name; the commit lists the files
of the attempts that count, so retried or speculative tasks leave no double
records and an aborted job none. Paths are anything ``pyarrow.fs`` opens.

``archive(pages, path)`` writes one record for each page: of records with equal
payloads of at least ``least`` bytes, the one with the largest page_id is a
response, and the others are revisits of it; all shorter ones are responses.

Defined cases: null html is an empty payload; null urls are empty; rows with a
null page_id are responses unless a row with a page_id has the same payload; rows
that repeat a page_id with the same payload are responses if it is the largest;
control characters in urls are percent-encoded; empty tables give an archive
without records; further columns are ignored.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .util import SALTS, ready, salt_of, salted, stored

LEAST = 1000
PARTITION_BYTES = 64 << 20
_LEVEL = 1
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_COLUMNS = ("record_type", "page_id", "url", "refers_to", "payload_digest", "payload_length", "file")
_SCHEMA = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()),
                     ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("file", pa.string())])
_DDL = "record_type string, page_id long, url string, refers_to long, payload_digest string, payload_length long, file string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# --- records -----------------------------------------------------------------

def record(kind: str, page_id: int | None, url: str | None, refers_to: int | None, digest: str, length: int, payload: bytes,
           date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only."""
    block = _HTTP + (payload if kind == "response" else b"")
    clean = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", clean),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(length))]
    if kind == "revisit":
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    """The page of one of our record ids; null for any other, and for numbers beyond 64 bits."""
    m = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", urn or "")
    n = int(m[1]) if m else None
    return n if n is not None and -2 ** 63 <= n < 2 ** 63 else None


def member(data: bytes, level: int = _LEVEL) -> bytes:
    """A gzip member whose extra field SL tells the length of what follows it."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"SL" + struct.pack("<HQ", 8, len(body))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body


def _parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in re.split("\r?\n", head.decode("utf-8", "replace"))[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def _payload(kind: str | None, record: _Record) -> bytes | None:
    """What a record is about: behind the HTTP header of a response or a
    request, the whole block of any other, nothing of a revisit."""
    if kind == "revisit":
        return None
    block = record.block()
    return block.partition(b"\r\n\r\n")[2] if kind in ("response", "request") else block


class _Record:
    """Headers of a record at hand, the block on demand."""

    def __init__(self, head: dict[str, str], block):
        self.head, self.block = head, block


def plain_records(f) -> Iterator[_Record]:
    """Records of an uncompressed archive; blocks not asked for are skipped."""
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        head = [line]
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
        fields = _parse(b"".join(head))
        size, at = int(fields.get("content-length", 0)), f.tell()
        yield _Record(fields, lambda size=size: f.read(size))
        f.seek(at + size)


def gzip_records(f, first: int = 1024) -> Iterator[_Record]:
    """Records of an archive with one gzip member for each; only the header is
    inflated unless the block is asked for."""
    while True:
        at = f.tell()
        fixed = f.read(10)
        if len(fixed) < 10:
            return
        length, skip = None, 10
        if fixed[3] & 4:
            extra = f.read(struct.unpack("<H", f.read(2))[0])
            skip += 2 + len(extra)
            i = 0
            while i + 4 <= len(extra):
                size = struct.unpack("<H", extra[i + 2:i + 4])[0]
                if extra[i:i + 2] == b"SL" and size == 8:
                    length = struct.unpack("<Q", extra[i + 4:i + 12])[0]
                i += 4 + size
        if length is None:
            f.seek(at)
            z = zlib.decompressobj(31)
        else:
            z = zlib.decompressobj(-15)
        got = b""
        while b"\r\n\r\n" not in got and not z.eof:
            data = f.read(first)
            if not data:
                break
            got += z.decompress(data, 4 * first) if not z.unconsumed_tail else z.decompress(z.unconsumed_tail + data, 4 * first)
        head, _, begun = got.partition(b"\r\n\r\n")

        def rest(z=z, begun=begun, state=[]) -> bytes:  # noqa: B006
            if not state:
                parts = [begun, z.decompress(z.unconsumed_tail)]
                while not z.eof and (data := f.read(1 << 16)):
                    parts.append(z.decompress(data))
                state.append(b"".join(parts))
            return state[0]

        fields = _parse(head)
        yield _Record(fields, lambda rest=rest, n=int(fields.get("content-length", 0)): rest()[:n])
        if length is not None:
            f.seek(at + skip + length)
        else:
            rest()
            f.seek(f.tell() - len(z.unused_data))


# --- the data source -----------------------------------------------------------

class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _DDL + (", payload binary" if self.options.get("payload", "false").lower() == "true" else "")

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


@dataclass
class Files(ds.InputPartition):
    paths: list[str]


class WarcReader(ds.DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "false").lower() == "true"
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        known = {ds.EqualTo: "=", ds.EqualNullSafe: "<=>", ds.In: "in", ds.IsNull: "null", ds.IsNotNull: "given",
                 ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
        for f in filters:
            op = known.get(type(f))
            column = ".".join(f.attribute) if op else None
            if op and column in _COLUMNS:
                self.tests.append((column, op, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for column, op, value in self.tests:
            v = row[column]
            if op == "null":
                ok = v is None
            elif op == "<=>":
                ok = v == value
            elif v is None:
                ok = False
            else:
                ok = {"=": lambda a, b: a == b, "in": lambda a, b: a in b, "given": lambda a, b: True, ">": lambda a, b: a > b,
                      ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[op](v, value)
            if not ok:
                return False
        return True

    def partitions(self) -> list[Files]:
        system, root = _open(self.path)
        listed = f"{root}/_files"
        if system.get_file_info(listed).type == pafs.FileType.File:
            with system.open_input_stream(listed) as f:
                names = [x for line in f.read().decode().splitlines() for x in json.loads(line)]
            infos = system.get_file_info([f"{root}/{n}" for n in names])
        else:
            infos = [i for i in system.get_file_info(pafs.FileSelector(root, recursive=True))
                     if i.type == pafs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        out, size = [Files([])], 0
        for i in sorted(infos, key=lambda i: i.path):
            if out[-1].paths and size + i.size > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(i.path)
            size += i.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        schema = _SCHEMA.append(pa.field("payload", pa.binary())) if self.payload else _SCHEMA
        rows, weight = [], 0
        for path in partition.paths:
            with io.BufferedReader(system.open_input_file(path), 1 << 18) as f:
                for r in (gzip_records if path.endswith(".gz") else plain_records)(f):
                    row = self.row(r.head, path)
                    if not self.wanted(row):
                        continue
                    if self.payload:
                        row["payload"] = _payload(row["record_type"], r)
                        weight += len(row["payload"] or b"")
                    rows.append(row)
                    if len(rows) >= 4096 or weight >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, weight = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    @staticmethod
    def row(head: dict[str, str], path: str) -> dict:
        length = head.get("x-payload-length")
        return {"record_type": head.get("warc-type"), "page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"),
                "refers_to": _page(head.get("warc-refers-to")), "payload_digest": (head.get("warc-payload-digest") or "").rpartition(":")[2],
                "payload_length": int(length) if re.fullmatch("[0-9]{1,18}", length or "") else None, "file": path}


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        try:
            for b in iterator:
                for r in zip(*(b.column(c).to_pylist() for c in (*_COLUMNS[:-1], "payload")), strict=True):
                    if out is None:
                        out = system.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                    kind, page_id, url, refers_to, digest, length, payload = r
                    out.write(member(record(kind, page_id, url, refers_to, digest, length, payload or b"", self.date)))
        finally:
            if out is not None:
                out.close()
        return Written([name] if out is not None else [])

    def commit(self, messages) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        listed, old = f"{root}/_files", b""
        if not self.overwrite and system.get_file_info(listed).type == pafs.FileType.File:
            with system.open_input_stream(listed) as f:
                old = f.read()
        with system.open_output_stream(listed) as f:
            f.write(old + "".join(json.dumps(m.names) + "\n" for m in messages if m).encode())

    def abort(self, messages) -> None:
        """Files that no commit lists are never read."""


def register(spark: SparkSession) -> None:
    ready(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# --- the job ---------------------------------------------------------------------

def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The record of each page: record_type, page_id, url, refers_to,
    payload_digest, payload_length, payload."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    # only payloads that occur twice move: one row for each, combined before the shuffle
    again = (p.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
             .where("n > 1 AND last IS NOT NULL").select("payload_digest", "last"))
    # written, so that the planner knows its size and moves no payload if it is small
    again = stored(again, "warc-again")
    j = p.withColumn("_salt", salt_of("page_id", "url")).join(salted(again, SALTS), ["payload_digest", "_salt"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return j.select(F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"), "page_id",
                    F.coalesce("url", F.lit("")).alias("url"), refers.alias("refers_to"), "payload_digest", "payload_length",
                    F.when(refers.isNull(), F.col("payload")).alias("payload"))


def archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write ``pages`` as WARC records under ``path``."""
    register(pages.sparkSession)
    records(pages, least).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
