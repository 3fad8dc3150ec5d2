"""WARC archives as a PySpark Python data source (`sparrowmill_warc`): reading, writing and payload deduplication.

Reading plans partitions from the files that a committed write names, whole files together up to `partition_bytes`. Headers
are parsed first. Filters that Spark pushes down (equality and IN on warc_type, record_id, target_uri, refers_to and
payload_digest) are decided on the headers alone, and the block of an unwanted record is skipped by seeking, or read past in
gzip archives, without decoding. A schema without `payload` skips every payload; with it, each payload's digest is verified. A damaged
record (a payload that its digest denies, no or a wrong Content-Length, no record where one should begin) ends the job with its file's name; with the
option `mode` = `permissive` its payload is null instead, and reading goes on at the next line that begins a record.

Writing puts one archive (or more, rolled at `file_bytes`) in the folder for each task attempt, under a name of its own, and
the commit lists the files of successful attempts in a manifest. Files of lost or repeated attempts are in no manifest, so
nothing is read twice. Archives are uncompressed, or gzip with one member for each record (`compression`).

Defined results for `archive`: a null payload counts as empty; among equal payloads the least page_id is the response and the
others, also rows without id, revisit it; rows that repeat the least id are responses too; without any id all are
responses; line breaks inside a URL are percent-encoded; a null URL has no header; an empty table writes no archive. A payload of any length is
one value of bytes while it is written or read, and is never cut. Only the id, URL and payload columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .tables import BROADCAST_DIGESTS, keyed_join, new_path, written

SCHEMA = "record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
FILE_BYTES = 256 << 20
PARTITION_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
_LINE = 1 << 16  # what is looked at of a line where a record should begin
_HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A").strip()


def record(record_id: str, warc_type: str, target_uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One record; a revisit keeps the HTTP head of the full payload but not the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if warc_type == "revisit" else head + payload
    lines = [f"WARC-Type: {warc_type}", f"WARC-Record-ID: <{_safe(record_id)}>", f"WARC-Date: {DATE}"]
    if target_uri is not None:
        lines.append(f"WARC-Target-URI: {_safe(target_uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_safe(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _headers(stream: io.BufferedIOBase, permissive: bool = False) -> dict[str, str] | None:
    """The next record's headers by lower-case name; None at the end. If `permissive`, lines before it are passed over."""
    line = stream.readline(_LINE)
    while line in (b"\r\n", b"\n") or permissive and line and not line.startswith(b"WARC/1."):
        line = stream.readline(_LINE)
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out, name = {}, ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _value(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(_HEADERS[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


def records(stream: io.BufferedIOBase, columns: list[str], wanted: list[tuple[str, frozenset]] = (), seekable: bool = True, permissive: bool = False) -> Iterator[tuple]:
    """The wanted columns of each record whose headers meet all conditions."""
    while (headers := _headers(stream, permissive)) is not None:
        stated = headers.get("content-length", "")
        if not stated.isdecimal():
            if not permissive:
                raise ValueError(f"{_value(headers, 'record_id')} has no Content-Length")
            if all(_value(headers, column) in values for column, values in wanted):
                yield tuple(None if c in ("payload", "payload_bytes") else _value(headers, c) for c in columns)
            continue
        left = int(stated)
        if all(_value(headers, column) in values for column, values in wanted):
            http = headers.get("content-type", "").startswith("application/http")
            payload, length, full = None, left, headers.get("warc-type") != "revisit"
            if http and ("payload" in columns or "payload_bytes" in columns):
                length = None if not full else left
                while left and (line := stream.readline(left)):
                    left -= len(line)
                    if full:
                        length -= len(line)
                    if line in (b"\r\n", b"\n"):
                        break
                    if line.lower().startswith(b"content-length:") and not full:
                        length = int(line.split(b":")[1])
            if "payload" in columns and full:
                payload = stream.read(left)
                left = 0
                stated = _value(headers, "payload_digest")
                if stated and stated != digest(payload):
                    if not permissive:
                        raise ValueError(f"payload digest of {_value(headers, 'record_id')} differs")
                    payload = None
            yield tuple(payload if c == "payload" else length if c == "payload_bytes" else _value(headers, c) for c in columns)
        if seekable:
            stream.seek(left, io.SEEK_CUR)
        else:
            while left and (part := stream.read(min(left, 1 << 20))):
                left -= len(part)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int, permissive: bool = False) -> None:
        self.path, self.columns, self.partition_bytes, self.permissive = path, schema.fieldNames(), partition_bytes, permissive
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted.append((f.attribute[0], values - {None}))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        entries = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        manifests = [e for e in entries if e.base_name.startswith("_manifest-")]
        named: set[str] = set()
        for entry in manifests:
            with store.open_input_stream(entry.path) as f:
                named.update(json.loads(f.read()))
        files = [e for e in entries if e.is_file and (e.base_name in named if manifests else e.base_name.endswith((".warc", ".warc.gz")))]
        out, size = [Files([])], 0
        for entry in sorted(files, key=lambda e: e.path):
            if out[-1].paths and size + entry.size > self.partition_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(entry.path)
            size += entry.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                packed = path.endswith(".gz")
                stream = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 16)
                try:
                    yield from records(stream, self.columns, self.wanted, not packed, self.permissive)
                except ValueError as error:
                    raise ValueError(f"{path}: {error}") from error


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool, compression: str, file_bytes: int) -> None:
        self.path, self.columns, self.overwrite, self.gzip, self.file_bytes = path, columns, overwrite, compression == "gzip", file_bytes

    def write(self, iterator: Iterator) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for row in iterator:
            payload = row["payload"]
            one = record(row["record_id"], row["warc_type"], row["target_uri"], row["refers_to"], bytes(payload) if payload is not None else b"")
            one = gzip.compress(one, mtime=0) if self.gzip else one
            if out is None or size + len(one) > self.file_bytes:
                if out:
                    out.close()
                names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0  # members are compressed one by one
            out.write(one)
            size += len(one)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        old = store.get_file_info(fs.FileSelector(root)) if self.overwrite else []
        names = [name for m in messages if m for name in m.names]
        manifest = f"_manifest-{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{root}/{manifest}") as f:
            f.write(json.dumps(names).encode())
        for entry in old:
            if entry.base_name not in names:
                store.delete_file(entry.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for name in (name for m in messages if m for name in m.names):
            store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparrowmill_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", PARTITION_BYTES)), self.options.get("mode", "failfast") == "permissive")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema.fieldNames(), overwrite, self.options.get("compression", "none"), int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let Spark hand it filters."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", compression: str = "none") -> None:
    """Write one record for each row; equal payloads are stored once and revisited."""
    register(pages.sparkSession)
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    copies = written(rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "warc-copies")
    # only digests that occur twice are looked up; many rows of one digest are a skewed join at most
    found = keyed_join(rows, copies, "key", "left", BROADCAST_DIGESTS)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    found.select(
        name("id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.when(again, name("first")).alias("refers_to"),
        "payload",
    ).write.format("sparrowmill_warc").option("compression", compression).mode("append").save(path)


def read(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("sparrowmill_warc").schema(columns).load(path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived with payloads deduplicated, then read back with every payload's digest verified."""
    path = new_path(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.expr(f"try_cast(substring({c}, length('urn:page:') + 1) as bigint)")
    return read(spark, path).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))


ORACLE = r"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
digests AS (SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM payloads)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::INT >> (15 - 5 * (k % 4))) & 31) + 1, 1) for k in range(32)], '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM digests"""
