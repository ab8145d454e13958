"""WARC files as a Spark source and sink, by the Python data source API, and records as articles.

A compressed file is read by ranges of bytes. Each record is a gzip member of its
own, and belongs to the range in which the member begins: a range looks for the first
member that inflates to the head of a record, and members are inflated one by one.
A member that is cut off or damaged is left out, and reading goes on at the next one.
Plain files have no such borders and are read by one task each, record by record.
Files are opened by the file systems of pyarrow, from a path or an address that it knows.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.text import domain_of, strip

SCHEMA = "id string, uri string, date string, type string, status int, payload binary"
_ARROW = pa.schema([("id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("type", pa.string()), ("status", pa.int32()), ("payload", pa.binary())])
#: Bytes of a range, of one read, and of payloads in one batch.
SPLIT, CHUNK, BATCH = 64 << 20, 1 << 20, 8 << 20
_MAGIC, _BEGIN = b"\x1f\x8b\x08", b"WARC/1."


def _place(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path if ":/" in path else "file://" + path)


def _begins(head: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(head, len(_BEGIN)) == _BEGIN
    except zlib.error:
        return False


def _border(f, at: int, stop: int) -> int | None:
    """The first position from at on, and before stop, where a record's member begins."""
    while at < stop:
        f.seek(at)
        chunk = f.read(CHUNK)
        found = chunk.find(_MAGIC)
        if found < 0:
            if len(chunk) < CHUNK:
                return None
            at += len(chunk) - len(_MAGIC) + 1
            continue
        at += found
        if at >= stop:
            return None
        f.seek(at)
        if _begins(f.read(1 << 16)):
            return at
        at += 1
    return None


def _member(f, at: int) -> tuple[bytes, int] | None:
    """The content and end of the member at this position; None if it is damaged or cut off."""
    f.seek(at)
    inflate, parts, read = zlib.decompressobj(31), [], 0
    try:
        while not inflate.eof:
            chunk = f.read(CHUNK)
            if not chunk:
                return None
            read += len(chunk)
            parts.append(inflate.decompress(chunk))
    except zlib.error:
        return None
    return b"".join(parts), at + read - len(inflate.unused_data)


def _members(f, start: int, stop: int) -> Iterator[bytes]:
    at = _border(f, start, stop)
    while at is not None:
        found = _member(f, at)
        if found:
            yield found[0]
        at = _border(f, found[1] if found else at + 1, stop)


def _records(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of the records of an open stream, up to one that is cut off."""
    while line := f.readline():
        if not line.startswith(_BEGIN):
            continue  # the empty lines between two records
        headers = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        body = f.read(int(length)) if line and length.isdigit() else None
        if body is None or len(body) < int(length):
            return
        yield headers, body


def _row(headers: dict[str, str], body: bytes) -> tuple:
    status = None
    if headers.get("warc-type") == "response" and body.startswith(b"HTTP/"):
        head, _, body = body.partition(b"\r\n\r\n")
        code = head.split(b"\r\n", 1)[0].split(b" ")[1:2]
        status = int(code[0]) if code and code[0].isdigit() else None
    return headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-type"), status, body


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[_Range]:
        files, root = _place(self.path)
        info = files.get_file_info(root)
        found = files.get_file_info(afs.FileSelector(root, recursive=True)) if info.type == afs.FileType.Directory else [info]
        ranges = []
        for one in sorted(found, key=lambda i: i.path):
            if one.type != afs.FileType.File or any(part.startswith(("_", ".")) for part in one.path[len(root) :].split("/")):
                continue
            if one.path.endswith(".warc.gz"):
                ranges += [_Range(one.path, at, min(at + self.split, one.size)) for at in range(0, one.size, self.split)]
            elif one.path.endswith(".warc") and one.size:
                ranges.append(_Range(one.path, 0, one.size))
        return ranges or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = _place(self.path)
        with files.open_input_file(partition.path) as f:
            streams = (io.BytesIO(data) for data in _members(f, partition.start, partition.stop)) if partition.path.endswith(".gz") else [io.BufferedReader(f, CHUNK)]
            rows, held = [], 0
            for stream in streams:
                for headers, body in _records(stream):
                    rows.append(_row(headers, body))
                    held += len(body)
                    if held > BATCH:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    """Each task writes a file aside; all move into place when all are whole."""

    def __init__(self, path: str):
        self.path, self.aside = path, f"_aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Written:
        files, root = _place(self.path)
        files.create_dir(f"{root}/{self.aside}")
        name, empty = f"part-{uuid.uuid4().hex}.warc.gz", True
        with files.open_output_stream(f"{root}/{self.aside}/{name}", compression=None) as out:
            for r in iterator:
                body = b"" if r.payload is None else bytes(r.payload)
                if (r.type or "response") == "response":
                    body = f"HTTP/1.1 {r.status or 200} OK\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                given = {"WARC-Type": r.type or "response", "WARC-Record-ID": r.id, "WARC-Target-URI": r.uri, "WARC-Date": r.date, "Content-Length": str(len(body))}
                head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in given.items() if v is not None)
                out.write(gzip.compress(f"WARC/1.0\r\n{head}\r\n".encode() + body + b"\r\n\r\n", mtime=0))
                empty = False
        if empty:
            files.delete_file(f"{root}/{self.aside}/{name}")
        return _Written("" if empty else name)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _place(self.path)
        for m in messages:
            if m and m.name:
                files.move(f"{root}/{self.aside}/{m.name}", f"{root}/{m.name}")
        self._clear(files, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, files: afs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.aside}").type == afs.FileType.Directory:
            files.delete_dir(f"{root}/{self.aside}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def read_warc(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(id, uri, date, type, status, payload): the records of a .warc or .warc.gz file, or of all in a folder and below; of a response the payload stands without its HTTP head."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("split", split).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    """One compressed file a partition, added to the folder. Records are (id, uri, date, payload) and may have a type and a status; a null payload is an empty one, other nulls are left out."""
    records.sparkSession.dataSource.register(WarcSource)
    own = lambda name, kind: F.col(name) if name in records.columns else F.lit(None).cast(kind).alias(name)
    records.select("id", "uri", "date", own("type", "string"), own("status", "int"), "payload").write.format("warc").mode("append").save(path)


def articles_of(records: DataFrame, hosts: tuple[str, ...] = (), since: str | None = None, before: str | None = None) -> DataFrame:
    """Articles from the answered pages: url, source_domain, date_download, title_page and html. Without hosts all are taken, else those hosts and what is below them; dates are bounds of the download, the second not included. Payloads are read as UTF-8, other bytes as U+FFFD."""
    html = F.make_valid_utf8(F.col("payload").cast("string"))
    title: Column = strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    made = records.where("type = 'response' and coalesce(status, 200) = 200").select(
        F.col("uri").alias("url"), domain_of(F.col("uri")).alias("source_domain"), F.try_to_timestamp("date").alias("date_download"), F.nullif(title, F.lit("")).alias("title_page"), html.alias("html")
    )
    if hosts:
        made = made.where(F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: (F.col("source_domain") == h) | F.endswith(F.col("source_domain"), F.concat(F.lit("."), h))))
    if since:
        made = made.where(F.col("date_download") >= F.lit(since).cast("timestamp"))
    return made.where(F.col("date_download") < F.lit(before).cast("timestamp")) if before else made
