"""WARC 1.1 archives as a Spark data source, for reading and writing.

Reading plans one partition for each run of files of about ``partitionBytes``;
files may be plain (.warc) or compressed by gzip (.warc.gz).
Filters on header columns are pushed down: a record's header is parsed first, and
the payload of a record that fails them, or that the query does not ask for
(option ``payload`` false), is skipped by its length without being decoded.

Values are taken as they stand, in UTF-8 or else Latin-1; of records that hold an HTTP
message the payload is what follows its head, and payload_length is its size.

Writing gives each task its own files, with names of their own for every attempt;
a manifest that the driver writes at the end names those that count, so what a
lost or repeated attempt has left is never read. Paths are opened by pyarrow, so
any store it knows will do.
"""

from __future__ import annotations

import datetime
import gzip
import json
import os
import posixpath
import re
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .blocks import Membership
from .components import Scratch

SCHEMA = "record_id string, record_type string, target_uri string, record_date string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Header lines of the columns; the last of them is this format's own extension.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "record_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
}
_COLUMNS = {v.lower(): k for k, v in HEADERS.items()}
MANIFEST = "_manifest.json"
#: Fixed value: the profile of revisits that have the payload of an earlier record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A writer begins a new file beyond this size, so that readers have files to share.
FILE_BYTES = 64 << 20
_BATCH_BYTES = 8 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub("^s3[an]://", "s3://", path)  # Hadoop's names of the same store
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class WarcDataSource(DataSource):
    """Format ``warc``. Options: path; payload (true); partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partitionBytes", 32 << 20))
        self.names = [f.name for f in schema.fields]
        self.schema = schema
        self.filters: list = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            if self._takes(f):
                self.filters.append(f)
            else:
                yield f

    def _takes(self, f) -> bool:
        if isinstance(f, Not):
            return self._takes(f.child)
        known = (EqualTo, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
        return isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in HEADERS

    def partitions(self) -> list[Files]:
        fs, root = filesystem(self.path)
        if fs.get_file_info(posixpath.join(root, MANIFEST)).type == pafs.FileType.File:
            with fs.open_input_stream(posixpath.join(root, MANIFEST)) as f:
                listed = [(x["name"], x["bytes"]) for x in json.loads(f.read())]
        else:
            found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
            listed = [(x.base_name, x.size) for x in found if x.type == pafs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))]
        out: list[Files] = []
        run: list[str] = []
        held = 0
        for name, size in sorted(listed):
            if run and held + size > self.partition_bytes:
                out.append(Files(tuple(run)))
                run, held = [], 0
            run.append(name)
            held += size
        if run:
            out.append(Files(tuple(run)))
        return out or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(self.path)
        rows: list[dict] = []
        held = 0
        for name in partition.names:
            with fs.open_input_file(posixpath.join(root, name)) as f:
                # one gzip member a record, as archives have it, or any other cut into members
                for row in self._records(gzip.GzipFile(fileobj=f) if name.endswith(".gz") else f):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 256
                    if held > _BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_length": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.names], self.names)

    def _records(self, f) -> Iterator[dict]:
        want = self.payload and "payload" in self.names
        source = _Buffered(f)
        while (line := source.line()) is not None:
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record starts at {source.at - len(line)}")
            row: dict = dict.fromkeys(HEADERS)
            size, told = 0, {}
            while line := source.line():
                key, _, value = _decoded(line).partition(":")
                told[key.strip().lower()] = value.strip()
            size = int(told.get("content-length", 0))
            escaped = told.get(ESCAPED.lower(), "").split(",")
            for key in _COLUMNS.keys() & told.keys():
                row[_COLUMNS[key]] = _opened(told[key]) if key in escaped else told[key]
            if row["payload_length"] is not None:
                row["payload_length"] = int(row["payload_length"])
            if not all(_meets(x, row) for x in self.filters):
                source.skip(size)
                continue
            row["payload"] = None
            if told.get("content-type", "").lower().startswith("application/http"):
                # other writers keep the head of the HTTP message before the payload
                body = source.take(size)
                head = body.find(b"\r\n\r\n") + 4 if b"\r\n\r\n" in body else 0
                if row["record_type"] != "revisit":
                    row["payload_length"] = size - head
                    row["payload"] = body[head:] if want else None
            elif want and row["record_type"] != "revisit":
                row["payload"] = source.take(size)
            else:
                source.skip(size)
            yield row


class _Buffered:
    """Lines and blocks of a file; what is skipped beyond the buffer is not read."""

    def __init__(self, f, chunk: int = 1 << 18) -> None:
        self.f, self.chunk = f, chunk
        self.data, self.pos, self.base = b"", 0, 0

    @property
    def at(self) -> int:
        return self.base + self.pos

    def _more(self, least: int) -> bool:
        rest = self.data[self.pos :]
        self.base, self.pos = self.base + self.pos, 0
        self.f.seek(self.base + len(rest))
        new = self.f.read(max(self.chunk, least))
        self.data = rest + new
        return bool(new)

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (end := self.data.find(b"\r\n", self.pos)) < 0:
            if not self._more(0):
                return None
        out = self.data[self.pos : end]
        self.pos = end + 2
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) - self.pos < n:
            if not self._more(n - (len(self.data) - self.pos)):
                raise ValueError("a record is cut off")
        out = self.data[self.pos : self.pos + n]
        self.pos += n
        return out

    def skip(self, n: int) -> None:
        if len(self.data) - self.pos >= n:
            self.pos += n
        else:
            self.base, self.data, self.pos = self.at + n, b"", 0


def _meets(f, row: dict) -> bool:
    if isinstance(f, Not):
        c = f.child
        if not isinstance(c, (IsNull, IsNotNull)) and row[c.attribute[0]] is None:
            return False  # unknown in SQL
        return not _meets(c, row)
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if value is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    return value.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in value


#: An own header: which headers of the record have values in per cent codes. All others are taken as they stand.
ESCAPED = "X-Escaped"


def _decoded(line: bytes) -> str:
    """A header line in UTF-8, or in Latin-1 if it is not."""
    try:
        return line.decode()
    except UnicodeDecodeError:
        return line.decode("latin-1")


def _needs_codes(value: str) -> bool:
    """Whether a value cannot stand on a header line as it is: line ends, outer blanks, nothing at all."""
    return not value or value != value.strip() or "\r" in value or "\n" in value


def _closed(value: str) -> str:
    """A value on one header line: line ends, per cents and blanks as per cent codes; for headers that ESCAPED names."""
    return re.sub(r"[\s%]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value) or "%"


def _opened(value: str) -> str:
    return "" if value == "%" else urllib.parse.unquote(value)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        # mandatory in a record; of one job, so that all attempts write the same
        self.date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, size, name = None, 0, ""
        try:
            for batch in iterator:
                columns = {c: batch.column(c) for c in batch.schema.names}
                for i in range(batch.num_rows):
                    if out is None or size > FILE_BYTES:
                        if out is not None:
                            out.close()
                            files.append((name, size))
                        name, size = f"part-{uuid.uuid4().hex}.warc", 0
                        out = fs.open_output_stream(posixpath.join(root, name))
                    head, escaped = ["WARC/1.1"], []
                    for column, key in HEADERS.items():
                        if column in columns and columns[column][i].is_valid:
                            value = columns[column][i].as_py()
                            if isinstance(value, str) and _needs_codes(value):
                                value = _closed(value)
                                escaped.append(key.lower())
                            head.append(f"{key}: {value}")
                    if escaped:
                        head.append(f"{ESCAPED}: {','.join(escaped)}")
                    if "record_date" not in columns or not columns["record_date"][i].is_valid:
                        head.append(f"WARC-Date: {self.date}")
                    if "record_type" in columns and columns["record_type"][i].as_py() == "revisit":
                        head.append(f"WARC-Profile: {PROFILE}")
                    payload = columns["payload"][i].as_py() if "payload" in columns else None
                    payload = payload or b""
                    if payload:
                        head.append("Content-Type: application/octet-stream")
                    head.append(f"Content-Length: {len(payload)}")
                    start = ("\r\n".join(head) + "\r\n\r\n").encode()
                    out.write(start)
                    out.write(payload)
                    out.write(b"\r\n\r\n")
                    size += len(start) + len(payload) + 4
        finally:
            if out is not None:
                out.close()
                files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        place = posixpath.join(root, MANIFEST)
        named = [{"name": n, "bytes": b} for m in messages if m is not None for n, b in m.files]
        if not self.overwrite and fs.get_file_info(place).type == pafs.FileType.File:
            with fs.open_input_stream(place) as f:
                named = json.loads(f.read()) + named
        with fs.open_output_stream(place) as f:
            f.write(json.dumps(named).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                try:
                    fs.delete_file(posixpath.join(root, name))
                except FileNotFoundError:
                    continue


def register(spark: SparkSession) -> None:
    """Makes the format known and lets Spark push filters into it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes rows with the columns of SCHEMA, those that are missing as null."""
    register(records.sparkSession)
    records.write.format("warc").mode(mode).save(path)


def records_of_pages(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """The records of pages (page_id, url, html); later copies of a payload become revisits.

    The payload is the html in UTF-8, a null one empty. Of pages with equal payloads
    of at least ``least_bytes``, that of the smallest id is a response, as are all
    rows of this id; others are revisits that refer to it and have no payload of
    their own. Pages without an id are responses, each with a record id of its own; rows
    that repeat an id repeat its record id. A null url gives no target. Extra
    columns are left out.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    # only ids and digests are grouped; counts and smallest ids are taken before the shuffle
    slim = base.where(f"payload_length >= {least_bytes}").select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).where("many > 1 and first is not null").select("digest", "first")
    later = slim.where("page_id is not null").join(first, "digest").where("page_id <> first").select("page_id", "digest", "first").distinct()
    # pages that surely are no copies stay where they are; the others are held against the list
    later = Scratch(pages.sparkSession, "revisits").save(later)
    doubtful, sure = Membership(later, "page_id").split(base, "page_id")
    told = sure.withColumn("first", F.lit(None).cast("long")).unionByName(doubtful.join(later, ["page_id", "digest"], "left"))
    # a page without an id has a record id that no other has
    name = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">")), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))
    again = F.col("first").isNotNull()
    return told.select(
        name("page_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, name("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def page_number(column: str):
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
