"""WARC archives: written by Spark's text writer, read by a Python data source.

*Writing.*  A WARC record is text with a blank line after it, so every page becomes one
row with the record separator as line separator.  Spark writes and commits the files on
any file system, and a lost executor costs a rewrite of its own files.

*Reading.*  ``spark.read.format("warc").load(path)``.  The driver lists the files and
plans partitions of whole files, filled up to ``partition_bytes``.  Predicates on the
record type and the other header columns are pushed down: of each record the headers
are parsed first, and a record that a predicate turns down, or whose payload is not
wanted (``payload`` option ``false``), is skipped without being decoded (a seek in a
plain file; a gzip file must be inflated to get past it).
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from .common import cut, fresh, same

RECORD_END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PAGE = "urn:page:"
#: payloads at least so long are stored once
LEAST_SHARED = 1000
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length long, content_length long, file string, offset long, payload binary"
ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
                   ("payload_length", pa.int64()), ("content_length", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())])
BATCH_ROWS, BATCH_BYTES, CHUNK = 1024, 16 << 20, 1 << 20


# --- writing -----------------------------------------------------------------


def shared_payloads(pages: DataFrame, page_id: str, digest: str, size: str, least: int = LEAST_SHARED) -> DataFrame:
    """``page_id, digest, keeper`` of the pages that repeat a payload of ``least`` bytes or more of the page ``keeper``."""
    rows = cut(pages.filter(F.col(page_id).isNotNull() & (F.col(size) >= least)).select(F.col(page_id).alias("p"), F.col(digest).alias("d")))
    keepers = rows.groupBy("d").agg(F.max("p").alias("keeper"), F.min("p").alias("least")).filter("least <> keeper").select("d", "keeper")
    # written, so that the planner knows its size when it meets the pages
    return cut(rows.join(keepers, "d").filter("p <> keeper").distinct())


def _header_value(value: Column) -> Column:
    """A header value on one line: blanks are percent-encoded, other control characters dropped."""
    for char in (" ", "\t", "\r", "\n"):
        value = F.replace(value, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.regexp_replace(value, r"[\x00-\x1f\x7f]", "")


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", compression: str = "gzip", least: int = LEAST_SHARED) -> None:
    """Write one record for each row of ``pages`` to a new folder ``path``.

    The payload is the text of ``html`` in UTF-8; null counts as empty.  Of pages with equal payloads of at least
    ``least`` bytes the one with the largest ``page_id`` is a ``response``, the others are ``revisit`` records that
    refer to it and carry no payload.  All smaller ones are responses, and so are rows with a null ``page_id`` (they
    cannot be referred to) and rows that repeat an id together with its payload.  A null ``url`` gives no target
    header; blanks in it are percent-encoded.  Other columns are not written.
    """
    body, digest, size, p, d, keeper = fresh(pages, "_body", "_digest", "_size", "_p", "_d", "_keeper")
    rows = pages.withColumn(body, F.coalesce(F.col(html), F.lit(""))).withColumns({digest: F.sha1(F.col(body).cast("binary")), size: F.octet_length(body)})
    shared = shared_payloads(rows, page_id, digest, size, least).select(F.col("p").alias(p), F.col("d").alias(d), F.col("keeper").alias(keeper))
    rows = rows.join(shared, same([page_id, digest], [p, d]), "left")
    revisit = F.col(keeper).isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    ident = lambda c: F.concat(F.lit(f"<{PAGE}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    length = F.when(revisit, F.lit(len(HTTP_HEAD))).otherwise(F.col(size) + len(HTTP_HEAD))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"), line("WARC-Record-ID", ident(page_id)), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _header_value(F.col(url))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col(digest))),
        line("WARC-Refers-To", F.when(revisit, ident(keeper))), F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n").otherwise(""),
        line("X-Payload-Length", F.col(size).cast("string")), F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n" + HTTP_HEAD),
    )
    record = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col(body)))
    rows.select(record.alias("value")).write.option("lineSep", RECORD_END).option("compression", compression).text(path)


# --- reading -----------------------------------------------------------------


def _filesystem(path: str):
    from pyarrow import fs

    if urlparse(path).scheme:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class _Plain:
    """A plain file: what is skipped is not read."""

    def __init__(self, file) -> None:
        self.file, self.at = io.BufferedReader(_Raw(file), CHUNK), 0

    def line(self) -> bytes:
        got = self.file.readline()
        self.at += len(got)
        return got

    def take(self, n: int) -> bytes:
        got = self.file.read(n)
        self.at += len(got)
        return got

    def skip(self, n: int) -> None:
        self.file.seek(n, io.SEEK_CUR)
        self.at += n


class _Gzip(_Plain):
    """A gzip file of any number of members: what is skipped is inflated and dropped, block by block."""

    def __init__(self, file) -> None:
        self.file, self.at = io.BufferedReader(_Inflated(file), CHUNK), 0

    def skip(self, n: int) -> None:
        while n > 0 and (got := self.take(min(n, CHUNK))):
            n -= len(got)


class _Raw(io.RawIOBase):
    def __init__(self, file) -> None:
        self.source = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        return self.source.seek(offset, whence)

    def tell(self) -> int:
        return self.source.tell()

    def readinto(self, out) -> int:
        got = self.source.read(len(out))
        out[: len(got)] = got
        return len(got)


class _Inflated(io.RawIOBase):
    def __init__(self, file) -> None:
        self.source, self.inflate, self.rest = file, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            data = self.inflate.unconsumed_tail or self.rest or self.source.read(CHUNK)
            self.rest = b""
            if not data:
                return 0
            got = self.inflate.decompress(data, len(out))
            if got:
                out[: len(got)] = got
                return len(got)


def headers(stream: _Plain) -> dict[str, str] | None:
    """The header fields of the next record, or None at the end."""
    while (version := stream.line()) in (b"\r\n", b"\n"):
        pass
    if not version:
        return None
    if not version.startswith(b"WARC/"):
        raise ValueError(f"no WARC record at {stream.at - len(version)}: {version[:40]!r}")
    found: dict[str, str] = {}
    while (line := stream.line()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(tuple(paths))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take predicates on header columns; hand the others back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            text = name in FIELDS and name != "payload_length"
            if text and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.wanted.append((name, "in", (f.value,)))
            elif text and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.wanted.append((name, "in", tuple(f.value)))
            elif text and isinstance(f, StringStartsWith):
                self.wanted.append((name, "starts", f.value))
            elif text and isinstance(f, IsNotNull):
                self.wanted.append((name, "there", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _filesystem(self.path)
        infos = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        files = sorted((i for i in infos if i.type == fs.FileType.File and i.size and i.base_name[0] not in "._"), key=lambda i: (-i.size, i.path))
        bins: list[list[str]] = []
        room = 0
        for f in files:
            if not bins or f.size > room:
                bins.append([])
                room = self.partition_bytes
            bins[-1].append(f.path)
            room -= f.size
        return [_Files(b) for b in bins] or [_Files([])]

    def _keeps(self, row: dict[str, object]) -> bool:
        for name, how, value in self.wanted:
            got = row[name]
            if got is None or how == "in" and got not in value or how == "starts" and not got.startswith(value):
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        rows: list[dict[str, object]] = []
        held = 0
        for path in partition.value:
            with system.open_input_file(path) as file:
                packed = file.read(2) == b"\x1f\x8b"
                file.seek(0)
                stream = (_Gzip if packed else _Plain)(file)
                while True:
                    offset = stream.at
                    if (found := headers(stream)) is None:
                        break
                    size = int(found["content-length"])
                    row = {n: found.get(h.lower()) for n, h in FIELDS.items()}
                    row |= {"record_id": _bare(row["record_id"]), "refers_to": _bare(row["refers_to"]), "content_length": size, "file": path, "offset": offset, "payload": None}
                    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
                    if not self._keeps(row):
                        stream.skip(size)
                        continue
                    if self.payload:
                        block = stream.take(size)
                        http = found.get("content-type", "").startswith("application/http")
                        row["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
                        held += size
                    else:
                        stream.skip(size)
                    rows.append(row)
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class WarcSource(DataSource):
    """Options: ``path`` (by ``load``), ``payload`` (``false`` leaves it null) and ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 64 << 20) -> DataFrame:
    """The records under ``path``; filters on header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partition_bytes", partition_bytes).load(path)


def page_of(uri: Column) -> Column:
    """The page id in a record id, null where there is none."""
    return F.when(uri.startswith(PAGE), F.nullif(F.substring(uri, len(PAGE) + 1, 20), F.lit("")).cast("long"))
