"""WARC 1.1 archives as a PySpark data source, and the archiving of pages with revisit records.

Format: one gzip member for each record, with the skip lengths that annex D.2 of the WARC standard describes ('sl' extra
field: compressed and uncompressed length), so a reader can pass over a record without inflating its payload."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage,
)

from quern.llm.storage import open_fs, scratch_path, shuffle_partitions

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Columns that a record's headers state directly, and the header of each; filters on them are decided before a block is read.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed when it has grown beyond this; each file is one read partition.
MAX_FILE_BYTES = 128 << 20
#: Rows are handed to Spark in batches of at most so many payload bytes.
BATCH_BYTES = 8 << 20
_FIXED = struct.Struct("<4sIBBHccHII")  # gzip header with one extra field of eight bytes


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pack_member(data: bytes) -> bytes:
    """One gzip member that states its compressed and uncompressed length."""
    deflate = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = _FIXED.size + len(body) + 8
    head = _FIXED.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"s", b"l", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def format_record(row: dict) -> bytes:
    """The bytes of a response or revisit record. A revisit has the HTTP header of its page and no payload."""
    kind, payload = row["record_type"], row["payload"] or b""
    n_bytes = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if kind != "revisit" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_clean(row['record_id'])}", f"WARC-Date: {_clean(row['date'] or '1970-01-01T00:00:00Z')}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["refers_to"] is not None:
        head.append(f"WARC-Refers-To: {_clean(row['refers_to'])}")
    if kind == "revisit":
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    """A header value cannot hold line ends."""
    return " ".join(value.splitlines()) if "\n" in value or "\r" in value else value


def parse_headers(data: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line (the version) is not one."""
    out = {}
    for line in data.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def header_row(head: dict[str, str]) -> dict:
    row = {c: head.get(h) for c, h in HEADER_OF.items()}
    if row["payload_digest"] is not None:
        row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
    return row


def matches(row: dict, filters: list[Filter]) -> bool:
    """Whether the header values pass all pushed filters."""
    for f in filters:
        value = row[f.attribute[0]]
        if isinstance(f, EqualTo):
            ok = value is not None and value == f.value
        elif isinstance(f, In):
            ok = value is not None and value in f.value
        elif isinstance(f, StringStartsWith):
            ok = value is not None and value.startswith(f.value)
        elif isinstance(f, IsNull):
            ok = value is None
        else:
            ok = value is not None
        if not ok:
            return False
    return True


class _Member:
    """One record of an archive: its headers first, the rest only on demand."""

    def __init__(self, stream, compressed: bool):
        self.stream, self.compressed = stream, compressed
        self.start = stream.tell()

    def headers(self) -> dict[str, str] | None:
        """The record's headers, or None at the end of the file."""
        self.size, self.inflate, self.tail, data = None, None, b"", b""
        if self.compressed:
            fixed = self.stream.read(_FIXED.size)
            if not fixed:
                return None
            if len(fixed) == _FIXED.size and fixed[3] & 4 and fixed[12:14] == b"sl":
                self.size = struct.unpack_from("<I", fixed, 16)[0]
            self.inflate = zlib.decompressobj(31)
            data = self.inflate.decompress(fixed)
            step = lambda: self._inflate(4096)
        else:
            step = lambda: self.stream.read(4096)
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = step()
            if not more and (not self.compressed or self.inflate.eof):
                if data.strip():
                    raise ValueError("a WARC record ends inside its headers")
                return None
            data += more
        while not data[:1].strip() and not self.compressed:
            data = data[1:]
            end -= 1
        head, self.tail = parse_headers(data[:end]), data[end + 4:]
        self.length = int(head.get("content-length", 0))
        return head

    def _inflate(self, n: int) -> bytes:
        raw = self.stream.read(n)
        return self.inflate.decompress(raw) if raw else b""

    def block(self) -> bytes:
        """The record's whole block."""
        parts, got = [self.tail], len(self.tail)
        while got < self.length:
            more = self._inflate(1 << 16) if self.compressed else self.stream.read(self.length - got)
            if not more and (not self.compressed or self.inflate.eof or not self.stream.tell() < self.stream.size()):
                raise ValueError("a WARC record is shorter than its Content-Length")
            parts.append(more)
            got += len(more)
        self.tail = b"".join(parts)
        return self.tail[: self.length]

    def more(self) -> bool:
        """Reads some more of the block; whether there was any."""
        before = len(self.tail)
        self.tail += self._inflate(4096) if self.compressed else self.stream.read(4096)
        return len(self.tail) > before

    def skip(self) -> None:
        """Go to the next record, inflating nothing where the member states its length."""
        if not self.compressed:
            over = len(self.tail) - self.length - 4
            self.stream.seek(self.stream.tell() - over)
        elif self.size:
            self.stream.seek(self.start + self.size)
        else:
            while not self.inflate.eof and self._inflate(1 << 16) is not None and self.stream.tell() < self.stream.size():
                pass
            if not self.inflate.eof:
                self.inflate.flush()
            self.stream.seek(self.stream.tell() - len(self.inflate.unused_data))


@dataclass
class FilePart(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """Options: path; payload (true: decode payloads; false: leave them null); verify (true: compute each payload's digest
    and fail where it differs from the header)."""

    def __init__(self, schema, options: dict):
        self.schema, self.path = schema, options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Takes filters on header columns (equality, IN, prefix, null tests); the rest stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, IsNull, IsNotNull)) and f.attribute[0] in HEADER_OF and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        fs, root = open_fs(self.path)
        manifest = f"{root}/_manifest.json"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                names = json.loads(f.read())["files"]
        elif fs.get_file_info(root).type == pafs.FileType.File:
            return [FilePart(self.path)]
        else:
            found = fs.get_file_info(pafs.FileSelector(root))
            names = sorted(x.base_name for x in found if x.type == pafs.FileType.File and x.base_name.endswith((".warc", ".warc.gz")))
        return [FilePart(f"{self.path}/{x}") for x in names] or [FilePart("")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = open_fs(partition.path)
        rows, held = [], 0
        names = ["record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "payload_bytes", "payload"]
        arrow = pa.schema([(c, pa.string()) for c in names[:6]] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        with fs.open_input_file(path) as f:
            magic = f.read(2)
            f.seek(0)
            while True:
                member = _Member(f, magic == b"\x1f\x8b")
                if (head := member.headers()) is None:
                    break
                row = header_row(head)
                if matches(row, self.filters):
                    row |= self._content(member, head, row)
                    rows.append(row)
                    held += len(row["payload"] or b"") + 512
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                member.skip()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def _content(self, member: _Member, head: dict[str, str], row: dict) -> dict:
        """Size and payload. Without need of the payload no more is read of a block than its HTTP header."""
        whole = self.payload or self.verify
        if row["record_type"] not in ("response", "revisit", "resource"):
            return {"payload_bytes": member.length, "payload": member.block() if self.payload else None}
        http = head.get("content-type", "").startswith("application/http")
        if whole:
            block = member.block()
        else:
            while http and b"\r\n\r\n" not in member.tail[: member.length] and len(member.tail) < member.length and member.more():
                pass
            block = member.tail[: member.length]
        inner, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        stated = parse_headers(inner).get("content-length")
        if row["record_type"] == "revisit":
            return {"payload_bytes": int(stated) if stated else None, "payload": None}
        if self.verify and row["payload_digest"] not in (None, base32_sha1(payload)):
            raise ValueError(f"the payload of {row['record_id']} does not have its stated digest")
        return {"payload_bytes": member.length - (len(inner) + 4 if http else 0), "payload": payload if self.payload else None}


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    records: int


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own names; only those of committed tasks get into the manifest that readers follow."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        files, records, out = [], 0, None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() > MAX_FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"{part:06d}-{len(files):03d}-{uuid.uuid4().hex}.warc.gz")
                        out = fs.open_output_stream(f"{root}/{files[-1]}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
                    out.write(pack_member(format_record(row | {"payload_digest": digest})))
                    records += 1
        finally:
            if out is not None:
                out.close()
        return Written(files, records)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        with fs.open_output_stream(f"{root}/_manifest.json") as f:
            f.write(json.dumps({"files": sorted(x for m in done for x in m.files), "records": sum(m.records for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        for name in (x for m in messages if m is not None for x in m.files):
            fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """`spark.read.format("warc")` and `df.write.format("warc")`; register with `register(spark)`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: Records with equal payloads are dealt to so many tasks each at least (as many as a shuffle has, if these are more), so no
#: payload gathers in one task.
SALTS = 32


def archive_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """Write one record for each row of `pages` to WARC files under `path`.

    The payload is `html` in UTF-8 (null: empty). Of records with equal payloads of at least `min_bytes` bytes, that with
    the smallest `key` is a response (ties: the smallest hash of the url; of rows alike in both, one) and the others are revisits that refer to it and carry no payload; smaller payloads are all responses. A null key counts as
    larger than any other and is written as `null`; keys that are no integers come back as null. Other columns are not archived. An empty table gives an archive
    without files.

    The first record of each payload comes from slim rows (digest, key), combined before each shuffle, first for each salt
    and then for each digest; the pages then join it on (digest, salt), so a payload that a third of all pages share is
    spread over tasks. Rows alike in key, url and payload meet in one task, which numbers them."""
    text, salts = F.coalesce(F.col(html).cast("string"), F.lit("")), max(SALTS, shuffle_partitions(pages.sparkSession))
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.xxhash64(F.col(url)), F.lit(0)).alias("tie"),
        text.alias("text"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.pmod(F.xxhash64(F.col(key), F.col(url)), F.lit(salts)).cast("int").alias("salt"),
    )
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "tie")).alias("first")
    partial = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes", "salt").agg(first)
    firsts = partial.groupBy("digest", "n_bytes").agg(F.min("first").alias("first"), F.collect_set("salt").alias("salts"))  # at most `salts` in a set
    firsts = firsts.withColumn("salt", F.explode("salts")).drop("salts")
    joined = rows.join(firsts, ["digest", "n_bytes", "salt"], "left")
    mark = F.struct(F.col("key").isNull().alias("last"), "key", "tie")
    place = F.row_number().over(Window.partitionBy("digest", "n_bytes", "salt").orderBy(mark))
    joined = joined.withColumn("place", place)  # of rows that repeat the first, one comes first in its salt
    again = F.col("first").isNotNull() & ((mark != F.col("first")) | (F.col("place") > 1))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    joined.select(
        ident(F.col("key")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.lit(None).cast("string").alias("date"), F.col("digest").alias("payload_digest"),
        F.when(again, ident(F.col("first.key"))).alias("refers_to"), F.col("n_bytes").alias("payload_bytes"),
        F.when(~again, F.col("text").cast("binary")).alias("payload"),
    ).write.format("warc").option("path", path).mode("append").save()


def read_archive(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records under `path`; without `payload` that column is null and payloads are not inflated beyond their HTTP header."""
    reader = spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower())
    return reader.load(path)


def archive_and_read(pages: DataFrame, key: str = "page_id", **columns) -> DataFrame:
    """Archive `pages` under the shared folder, read the archives back (each payload checked against its digest) and
    return a row for each page."""
    spark = pages.sparkSession
    register(spark)
    path = scratch_path(spark, "warc")
    archive_pages(pages, path, key=key, **columns)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_archive(spark, path, payload=False, verify=True).select(
        number(F.col("record_id")).alias(key), "payload_bytes", "payload_digest", "record_type",
        number(F.col("refers_to")).alias("refers_to"), "target_uri",
    )
