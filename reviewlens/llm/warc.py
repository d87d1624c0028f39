"""WARC archives as a Spark data source, written and read in parallel.

``register(spark)``, then ``df.write.format("warc").save(folder)`` and
``spark.read.format("warc").load(folder)``. A write leaves a manifest of its own
with the files of the tasks that were committed and places where a file can be
split; a folder is read by all its manifests. One of an overwrite names those that
it replaces, so readers see either the old or the new content.
Every record is a gzip member of its own whose header gives the member's length,
so that a reader inflates the WARC header, decides, and steps over the rest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from reviewlens.llm.common import materialise, pick, table
from reviewlens.operators.skew import lookup_join
from reviewlens.session import scratch_path

MANIFEST = "_manifest.json"
_MANIFEST_START = "_manifest"
SPLIT_BYTES = 64 << 20
#: A record is read by pieces; so many bytes nearly always hold its WARC and HTTP headers.
HEAD_BYTES = 8192
LEVEL = 1

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, refers_to string, "
    "payload_digest string, payload_bytes bigint, content_type string, headers map<string,string>, payload binary"
)
#: Columns that are WARC headers; these and the record type can be tested before the payload is read.
_FIELDS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
    "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_GZIP_HEAD = struct.Struct("<4sIBBH2sHII")


def digest(payload: bytes) -> str:
    """SHA-1 as bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def member(record: bytes) -> bytes:
    """A gzip member whose extra field holds the lengths of the member and of the record."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    length = _GZIP_HEAD.size + len(body) + 8
    lengths = (length, len(record)) if max(length, len(record)) < 1 << 32 else (0, 0)
    head = _GZIP_HEAD.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, *lengths)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(fields: dict[str, str | None], payload: bytes) -> bytes:
    """A WARC record. A revisit keeps the digest and the length of its payload, not the payload."""
    revisit = fields["WARC-Type"] == "revisit"
    block = _HTTP_HEAD + (b"" if revisit else payload)
    fields = fields | {
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Profile": _PROFILE if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = [f"{name}: {_one_line(value)}\r\n" for name, value in fields.items() if value is not None]
    return b"WARC/1.1\r\n" + "".join(lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    size: int
    splits: list[int]


class WarcWriter(DataSourceArrowWriter):
    """Columns record_type, record_id, target_uri, warc_date, refers_to (strings) and payload (binary)."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = _filesystem(self.path)
        out, name, size, splits = None, None, 0, []
        try:
            for batch in iterator:
                for row in range(batch.num_rows):
                    value = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                    record = record_bytes(
                        {
                            "WARC-Type": value["record_type"], "WARC-Record-ID": f"<{value['record_id']}>",
                            "WARC-Date": value["warc_date"], "WARC-Target-URI": value["target_uri"],
                            "WARC-Refers-To": f"<{value['refers_to']}>" if value["refers_to"] is not None else None,
                        },
                        value["payload"] or b"",
                    )
                    if out is None:  # a name of its own for each attempt; only committed ones are in the manifest
                        files.create_dir(folder, recursive=True)
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{folder}/{name}", compression=None)
                    if size - (splits[-1] if splits else 0) >= SPLIT_BYTES:
                        splits.append(size)
                    data = member(record)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(name, size, splits)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = _filesystem(self.path)
        files.create_dir(folder, recursive=True)
        written = [m for m in messages if m is not None and m.name]
        known = {"files": [{"name": m.name, "bytes": m.size, "splits": m.splits} for m in written]}
        before = manifests(files, folder) if self.overwrite else {}
        if before:
            known["replaces"] = sorted(before)
        name = f"{_MANIFEST_START}-{uuid.uuid4().hex}.json"
        # Written aside first, since a stream that breaks off must not leave half a manifest.
        with files.open_output_stream(f"{folder}/.{name}") as out:
            out.write(json.dumps(known).encode())
        files.move(f"{folder}/.{name}", f"{folder}/{name}")
        for old, content in before.items():
            for part in content["files"]:
                _remove(files, f"{folder}/{part['name']}")
            _remove(files, f"{folder}/{old}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Removes what the tasks of a failed job had written; nothing refers to it."""
        files, folder = _filesystem(self.path)
        for message in messages:
            if message is not None and message.name:
                _remove(files, f"{folder}/{message.name}")


def _remove(files: pyarrow.fs.FileSystem, path: str) -> None:
    if files.get_file_info(path).type == pyarrow.fs.FileType.File:
        files.delete_file(path)


def manifests(files: pyarrow.fs.FileSystem, folder: str) -> dict[str, dict]:
    """The valid manifests of a folder by name, those that a later one replaces left out."""
    found = {}
    for info in files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.startswith(_MANIFEST_START) and info.base_name.endswith(".json"):
            with files.open_input_stream(info.path) as source:
                found[info.base_name] = json.loads(source.read())
    replaced = {name for content in found.values() for name in content.get("replaces", ())}
    return {name: content for name, content in sorted(found.items()) if name not in replaced}


@dataclass
class Span(InputPartition):
    """Records of ``file`` that begin at ``begin`` or later and before ``end`` (None: up to the file's end)."""

    file: str
    begin: int
    end: int | None

    def __init__(self, file: str, begin: int, end: int | None):
        self.file, self.begin, self.end = file, begin, end


def plan_spans(path: str) -> list[Span]:
    """Partitions of a folder or file: by the manifest's split places, or one for each archive without."""
    files, folder = _filesystem(path)
    info = files.get_file_info(folder)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pyarrow.fs.FileType.File:
        return [Span(folder, 0, None)]
    known = manifests(files, folder)
    if known:
        return [
            Span(f"{folder}/{f['name']}", begin, end)
            for content in known.values()
            for f in content["files"]
            for begin, end in zip([0, *f["splits"]], [*f["splits"], f["bytes"]], strict=True)
        ]
    found = files.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True))
    return [Span(f.path, 0, None) for f in sorted(found, key=lambda f: f.path) if f.path.endswith((".warc", ".warc.gz"))]


class _Plain:
    """Records of an archive that is not compressed."""

    def __init__(self, source, at: int):
        self.source, self.at = source, at

    def start(self) -> bool:
        self.source.seek(self.at)
        self.head = self.source.read(HEAD_BYTES)
        return bool(self.head.strip())

    def read(self, size: int) -> bytes:
        """The first ``size`` bytes of the record, or fewer at the end of the file."""
        if size > len(self.head):
            self.head += self.source.read(size - len(self.head))
        return self.head[:size]

    def skip(self, length: int) -> None:
        self.at += length


class _Gzip:
    """Records that are gzip members; whole-file compression is one member with many records."""

    def __init__(self, source, at: int):
        self.source, self.at, self.left = source, at, b""
        self.inflate, self.member_at, self.known = None, at, 0

    def start(self) -> bool:
        if self.left.strip(b"\r\n"):
            self.left = self.left.lstrip(b"\r\n")
            return True
        if self.inflate is not None and not self.inflate.eof and self._more(HEAD_BYTES):
            return True
        self.source.seek(self.at)
        self.raw = self.source.read(HEAD_BYTES)
        if len(self.raw) < 18:
            return False
        fields = _GZIP_HEAD.unpack(self.raw[: _GZIP_HEAD.size]) if len(self.raw) >= _GZIP_HEAD.size else (b"",)
        own = fields[0] == b"\x1f\x8b\x08\x04" and fields[5] == b"sl"
        self.member_at, self.known = self.at, fields[7] if own else 0
        self.inflate, self.left, self.pushed = zlib.decompressobj(31), b"", 0
        return self._more(HEAD_BYTES)

    def _more(self, size: int) -> bool:
        """Inflates until ``size`` bytes are there or the member ends."""
        while len(self.left) < size and not self.inflate.eof:
            data = self.raw or self.source.read(1 << 20)
            found = self.inflate.decompress(data, size - len(self.left))
            self.left += found
            # At a member's end, what follows it may stand in both of these.
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.pushed += len(data) - len(self.raw)
            if not data and not found:
                break  # the file ends inside the member
        if self.inflate.eof:
            self.at = self.member_at + self.pushed
        return bool(self.left)

    def read(self, size: int) -> bytes:
        self._more(size)
        return self.left[:size]

    def skip(self, length: int) -> None:
        if self.known:  # the member is this record: nothing more of it is inflated
            self.at, self.left, self.inflate = self.member_at + self.known, b"", None
        else:
            self._more(length + 1)
            self.left = self.left[length:]


def read_records(source, begin: int, end: int | None, wanted, with_payload: bool, verify: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, payload) of the records of an open archive that ``wanted`` accepts by their headers."""
    source.seek(begin)
    records = (_Gzip if source.read(2) == b"\x1f\x8b" else _Plain)(source, begin)
    while (end is None or records.at < end) and records.start():
        size = HEAD_BYTES
        while (stop := records.read(size).find(b"\r\n\r\n")) < 0:
            if len(records.read(size)) < size:
                raise ValueError(f"a WARC header that does not end, at byte {records.at}")
            size *= 2
        lines = records.read(size)[:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {records.at}")
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        block = int(headers["content-length"])
        length = stop + 4 + block + 4
        if wanted(headers):
            payload = None
            if headers.get("warc-type") != "revisit" and (with_payload or verify or "warc-payload-length" not in headers):
                content = records.read(stop + 4 + block)[stop + 4 :]
                if headers.get("content-type", "").startswith("application/http"):
                    content = content[content.find(b"\r\n\r\n") + 4 :]
                payload = content
                known = headers.get("warc-payload-digest", "")
                if verify and known.startswith("sha1:") and known[5:] != digest(payload):
                    raise ValueError(f"the payload of {headers.get('warc-record-id')} does not have its digest")
                headers["warc-payload-length"] = str(len(payload))
            yield headers, payload
        records.skip(length)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, verify: bool):
        self.path, self.columns, self.verify = path, schema.names, verify
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes tests of header columns; Spark applies all others, after the payload was read."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = {EqualTo: "equal", In: "in", StringStartsWith: "starts", IsNotNull: "there"}.get(type(f))
            if name in _FIELDS and kind:
                value = f.value if kind in ("equal", "in", "starts") else None
                self.tests.append((name, kind, tuple(value) if kind == "in" else value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return plan_spans(self.path) or [Span("", 0, 0)]

    def _wanted(self, headers: dict) -> bool:
        for name, kind, value in self.tests:
            found = field_value(headers, name)
            if found is None:
                return False
            if kind == "equal" and found != value or kind == "in" and found not in value:
                return False
            if kind == "starts" and not found.startswith(value):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files, _ = _filesystem(self.path)
        with files.open_input_file(partition.file) as source:
            rows, held = [], 0
            with_payload = "payload" in self.columns
            found = read_records(source, partition.begin, partition.end, self._wanted, with_payload, self.verify)
            for headers, payload in found:
                rows.append((headers, payload if with_payload else None))
                held += len(payload or b"") if with_payload else 0
                if len(rows) >= 512 or held >= 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple[dict, bytes | None]]) -> pa.RecordBatch:
        made = {
            "headers": lambda: pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string())),
            "payload": lambda: pa.array([p for _, p in rows], pa.binary()),
            "payload_bytes": lambda: pa.array([int(n) if (n := h.get("warc-payload-length")) else None for h, _ in rows], pa.int64()),
        }
        arrays = [
            made[c]() if c in made else pa.array([field_value(h, c) for h, _ in rows], pa.string()) for c in self.columns
        ]
        return pa.RecordBatch.from_arrays(arrays, list(self.columns))


def field_value(headers: dict, column: str) -> str | None:
    """A header as its column shows it: identifiers without brackets, digests without the algorithm."""
    value = headers.get(_FIELDS[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


class WarcSource(DataSource):
    """Options: path; verify=true recomputes every payload's digest. A schema without ``payload`` leaves payloads out."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.options.get("verify", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark push filters into Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """WARC records of pages. Of equal payloads of at least ``least_bytes``, the largest key is the response.

    The others revisit it; rows that share the largest key are all responses. A
    null html is an empty payload; a null key is smaller than all others.
    """
    rows = pick(pages, id=key, target_uri=url, html=html).select(
        "id", "target_uri", F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("same", F.sha2("payload", 256))
    # Partial counts leave the map tasks. Digests that repeat are few or looked up: payloads rarely move for them.
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("same")
    groups = groups.agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").withColumn("repeats", F.lit(True))
    joined = lookup_join(rows, materialise(groups, "repeated-payloads"), "same", "n", F.coalesce(F.col("id").cast("string"), F.lit("")))
    revisit = F.col("repeats") & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("id").alias("record_id"), "target_uri",
        F.lit(date).alias("warc_date"), F.when(revisit, urn("first")).alias("refers_to"), "payload",
    )


def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Archives in the shared folder, read back without keeping payloads but with every digest recomputed."""
    register(spark)
    path = scratch_path(spark, "warc")
    page_records(table(spark, sf, "pages")).write.format("warc").mode("append").save(path)
    schema = "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes bigint"
    found = spark.read.format("warc").schema(schema).option("verify", "true").load(path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


def warc_pushdown(spark: SparkSession, sf: str) -> DataFrame:
    """Payload digests of the responses from https pages: all other records are stepped over, their payloads not inflated."""
    register(spark)
    path = scratch_path(spark, "warc")
    page_records(table(spark, sf, "pages")).write.format("warc").mode("append").save(path)
    found = spark.read.format("warc").schema("record_type string, record_id string, target_uri string, payload binary").load(path)
    found = found.where((F.col("record_type") == "response") & F.col("target_uri").startswith("https://"))
    return found.select(
        F.expr("try_cast(substring(record_id, 10) as bigint)").alias("page_id"), "target_uri",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_sha1"),
    )


PUSHDOWN_ORACLE = """
  select page_id, url as target_uri, octet_length(encode(coalesce(html, ''))) as payload_bytes,
    sha1(coalesce(html, '')) as payload_sha1
  from (select *, max(page_id) over (partition by coalesce(html, '')) as first from pages)
  where page_id is not distinct from first and starts_with(url, 'https://')
"""
