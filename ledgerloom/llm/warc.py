"""WARC archives as a PySpark data source: file partitions, pushed-down header predicates, headers before payloads."""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage,
)

from ledgerloom.llm.storage import stored

REVISIT_BYTES = 100  # least payload that a later equal one may refer to
PARTITION_BYTES = 64_000_000  # compressed, of small files that one task reads; a larger file is alone
SUFFIX = ".warc.gz"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length long, "
    "refers_to string, payload binary"
)
#: WARC header of each column.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To",
}
BARE = {"record_id", "refers_to"}  # written between angle brackets
EPOCH = "1970-01-01T00:00:00Z"


def file_system(path: str):
    """Local folders, file:// and the remote stores that Arrow knows."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def member(record: bytes) -> bytes:
    """A gzip member of its own whose header says how long it is, so that readers can step over it."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\x00" * 4 + b"\x04\xff" + struct.pack("<H2sHI", 8, b"SL", 4, size % (1 << 32))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) % (1 << 32))


def _escaped(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in value)


def record(columns: dict) -> bytes:
    """One record: WARC headers, and for `response` an HTTP block around the payload (for `revisit` its head alone)."""
    lines = ["WARC/1.1"]
    for name, header in HEADERS.items():
        value = columns.get(name)
        if value is not None:
            lines.append(f"{header}: <{value}>" if name in BARE else f"{header}: {_escaped(str(value))}")
    payload = columns.get("payload") or b""
    kind = columns["record_type"]
    block = payload
    if kind in ("response", "revisit"):
        lines.append("Content-Type: application/http;msgtype=response")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {columns.get('payload_length') or len(payload)}\r\n\r\n".encode()
        block += payload if kind == "response" else b""
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Inflated(io.RawIOBase):
    """One gzip member of a file as a stream; it inflates only what is read."""

    def __init__(self, source, head: bytes):
        self.source, self.unzip, self.rest = source, zlib.decompressobj(31), head
        self.after = b""

    def readable(self):
        return True

    def readinto(self, into):
        while not self.unzip.eof:
            data = self.unzip.decompress(self.rest, len(into))
            self.rest = self.unzip.unconsumed_tail
            if self.unzip.eof:
                self.after = self.unzip.unused_data
            if data:
                into[: len(data)] = data
                return len(data)
            if not self.unzip.eof and not self.rest:
                self.rest = self.source.read(1 << 16)
                if not self.rest:
                    raise EOFError("a WARC file ends inside a record")
        return 0


def _headers(stream) -> dict[str, str] | None:
    """Headers of the next record by lower-case name; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:60]!r}")
    found: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:
            found[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        found[name] = value.strip()
    return found


def _skip(stream, n: int) -> None:
    while n > 0:
        got = len(stream.read(min(n, 1 << 16)))
        if not got:
            raise EOFError("a WARC file ends inside a record")
        n -= got


def _columns(headers: dict[str, str]) -> dict:
    row: dict = {}
    for name, header in HEADERS.items():
        value = headers.get(header.lower())
        row[name] = value.strip("<>") if value is not None and name in BARE else value
    length = row["payload_length"]
    row["payload_length"] = int(length) if length is not None and length.isdigit() else None
    return row


def _payload(stream, headers: dict[str, str]) -> bytes:
    """The block; of an HTTP message what follows its own headers."""
    size = int(headers.get("content-length", 0))
    block = stream.read(size)
    if len(block) < size:
        raise EOFError("a WARC file ends inside a record")
    if headers.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return block


def read_file(source, size: int, wanted, payloads: bool):
    """Rows of one archive, plain or with a gzip member a record. `wanted` judges the headers; the payload of a record that
    it rejects, or all if `payloads` is false, are stepped over: by a seek where the member tells its length."""
    position = 0
    while position < size:
        source.seek(position)
        head = source.read(20)
        if head[:2] != b"\x1f\x8b":
            source.seek(position)
            stream = io.BufferedReader(source) if not isinstance(source, io.BufferedReader) else source
            while (headers := _headers(stream)) is not None:
                row = _columns(headers)
                if wanted(row) and payloads:
                    yield row | {"payload": _payload(stream, headers)}
                    continue
                if wanted(row):
                    yield row | {"payload": None}
                _skip(stream, int(headers.get("content-length", 0)))
            return
        known = struct.unpack("<I", head[16:20])[0] if head[3] == 4 and head[12:16] == b"SL\x04\x00" else 0
        inflated = _Inflated(source, head)
        stream = io.BufferedReader(inflated, 1 << 14)
        while (headers := _headers(stream)) is not None:
            row = _columns(headers)
            take = wanted(row)
            if take and payloads:
                yield row | {"payload": _payload(stream, headers)}
                continue
            if take:
                yield row | {"payload": None}
            if known:
                break
            _skip(stream, int(headers.get("content-length", 0)))
        if known:
            position += known
            continue
        while not inflated.unzip.eof:
            stream.read(1 << 16)
        position = source.tell() - len(inflated.after)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads = path, payloads
        self.tests: list[tuple[str, frozenset]] = []
        self.present: list[str] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.value is not None:
                self.tests.append((f.attribute[0], frozenset([f.value])))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], frozenset(f.value)))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.present.append(f.attribute[0])
            else:
                yield f

    def partitions(self):
        system, path = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.base_name[:1] not in "._" and f.base_name.endswith((SUFFIX, ".warc")))
        groups: list[list[tuple[str, int]]] = []
        room = 0
        for name, size in files:
            if not groups or size > room:
                groups.append([])
                room = PARTITION_BYTES
            groups[-1].append((name, size))
            room -= size
        return [Files(g) for g in groups] or [Files([])]

    def _wanted(self, row: dict) -> bool:
        return all(row[n] in values for n, values in self.tests) and all(row[n] is not None for n in self.present)

    def read(self, partition):
        system, _ = file_system(self.path)
        names = [*HEADERS, "payload"]
        kinds = [pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string() for n in names]
        held: list[dict] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for name, length in partition.files:
            with system.open_input_file(name) as source:
                for row in read_file(source, length, self._wanted, self.payloads):
                    held.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 4_000_000:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Each task writes one hidden file; the commit renames those of the attempts that count, so a lost task leaves nothing to read."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}{SUFFIX}"
        with system.open_output_stream(f"{path}/.{name}", compression=None) as out:
            out.write(member(record({"record_type": "warcinfo", "record_id": f"urn:uuid:{uuid.uuid4()}", "date": EPOCH, "payload": b"format: WARC File Format 1.1\r\n"})))
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(member(record(row)))
        return Written([name])

    def commit(self, messages):
        system, path = file_system(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            system.move(f"{path}/.{name}", f"{path}/{name}")

    def abort(self, messages):
        system, path = file_system(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            system.delete_file(f"{path}/.{name}")


class WarcDataSource(DataSource):
    """Format "warc". Options: path; payload ("false": payloads are never inflated beyond the headers, and come back null)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """A record per row of `pages` (page_id, url, html), as the data source writes them.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least `least` bytes that with the smallest
    page_id is the response and the others revisit it; smaller payloads are all responses, and so is a row that repeats
    that page_id. Where no equal payload has an id, all are responses. Sizes and digests are found first; the join
    sees only payloads that occur more than once.
    """
    sized = pages.select(
        "page_id", F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumns({"payload_length": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = sized.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1 and first_id is not null").select("payload_digest", "first_id"), "warc-repeated")
    joined = sized.join(first, "payload_digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    named = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return joined.select(
        named(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.lit(EPOCH).alias("date"), F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"), "payload_length",
        F.when(again, named(F.col("first_id"))).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def page_of(record_id: Column) -> Column:
    """The page_id in a record's name; null for `null` and for other records."""
    return F.regexp_extract(record_id, r"^urn:page:(-?\d+)$", 1).try_cast("long")
