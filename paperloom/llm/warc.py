"""WARC archives as a Spark data source: one gzip member per record, written and read by tasks.

Reading is splittable. The driver only lists files and cuts them into byte ranges. A task looks in its range for
the gzip magic, decodes the head of each candidate member and accepts it if a WARC version line and header
block come out, so magic bytes inside compressed data are passed over. A task owns the records that start inside
its range, and reads past the end of the range to finish the last of them. Within a run of members the next
start is where the last member ended.

Writing gives each task its own file under a temporary name; the commit on the driver renames the files of the
successful attempts alone, so lost executors and repeated attempts leave no half archive behind.

Files are reached through pyarrow's file systems (local, HDFS, S3, GCS by the path's scheme), on executors as on
the driver. An archive stored uncompressed inside a record could pass for records when a range begins inside it:
read such files with splitBytes=0 (one task a file).

Defined results: null payloads are empty; null urls have no target header; repeated rows are separate
records; an empty table makes an empty archive, which reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .common import scratch, table

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d+\.\d+")
CHUNK = 1 << 20
SPLIT = 16 << 20
#: Bytes that are read and unpacked first to see a record's headers; each further step takes twice as many.
HEAD = 4096
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

WRITE_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
READ_SCHEMA = "path string, offset long, " + WRITE_SCHEMA


def file_system(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def member(row) -> bytes:
    """One record as one gzip member. payload_digest is the hex SHA-1 of the full payload, also for revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    block = http + (bytes(row.payload or b"") if row.record_type == "response" else b"")
    heads = [
        ("WARC-Type", row.record_type),
        ("WARC-Record-ID", f"<{row.record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", row.target_uri and "".join(c if c >= " " else f"%{ord(c):02X}" for c in row.target_uri)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row.payload_digest)).decode()),
        ("WARC-Refers-To", row.refers_to and f"<{row.refers_to}>"),
        ("WARC-Profile", REVISIT if row.record_type == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads if v) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}


def parse(record: bytes) -> tuple:
    """The columns of WRITE_SCHEMA from an unpacked record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    h = headers(head)
    block = rest[: int(h.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    bare = lambda x: x.strip("<>") if x else None
    kind = h.get("warc-type")
    if kind == "revisit":
        digest, size = base64.b32decode(h["warc-payload-digest"].split(":")[1]).hex(), int(headers(http).get("content-length", 0))
        payload = b""
    else:
        if not h.get("content-type", "").startswith("application/http"):
            payload = block
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return bare(h.get("warc-record-id")), kind, h.get("warc-target-uri"), bare(h.get("warc-refers-to")), digest, size, payload


class _Window:
    """A file's bytes from any offset on, read in chunks."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        return self.file.read_at(n, at) if n > 0 else b""

    def starts_record(self, at: int) -> bool:
        """True if a gzip member begins here that decodes to a WARC record's headers, with a type and a length.

        Headers may be of any length; they are read line by line. What does not begin with a version line, or lacks these
        two headers, is no record; one whose headers are cut off or damaged is an error, as it would be lost otherwise.
        """
        unzip, place, rest, first, step = zlib.decompressobj(31), at, b"", None, HEAD
        kind = length = False
        while True:
            chunk = unzip.unconsumed_tail or self.read(place, step)
            place += 0 if unzip.unconsumed_tail else len(chunk)
            try:
                rest += unzip.decompress(chunk, step) if chunk else b""
            except zlib.error as error:
                if first is None:
                    return False
                raise ValueError(f"the record at {at} is damaged") from error
            if first is None and not rest.startswith(b"WARC/"[: len(rest)]):
                return False
            *lines, rest = rest.split(b"\r\n")
            for line in lines:
                if first is None:
                    first = line
                    if not VERSION.fullmatch(first):
                        return False
                elif not line:
                    return kind and length
                name, colon, value = line.partition(b":")
                kind |= bool(colon) and name.strip().lower() == b"warc-type" and bool(value.strip())
                length |= bool(colon) and name.strip().lower() == b"content-length" and value.strip().isdigit()
            step = min(2 * step, CHUNK)
            if unzip.eof or not chunk:
                if first is None:
                    return False
                raise ValueError(f"the headers of the record at {at} are cut off")

    def find_record(self, start: int, end: int) -> int | None:
        """The first validated member that starts in [start, end)."""
        at = start
        while at < end:
            chunk = self.read(at, min(CHUNK, end - at) + len(MAGIC) - 1)
            place = chunk.find(MAGIC)
            while place >= 0:
                if at + place < end and self.starts_record(at + place):
                    return at + place
                place = chunk.find(MAGIC, place + 1)
            at += CHUNK
        return None

    def unpack(self, start: int) -> tuple[bytes, int]:
        """The member's content and the offset just after it."""
        unzip, out, at = zlib.decompressobj(31), [], start
        while not unzip.eof:
            chunk = self.read(at, 64 << 10)
            if not chunk:
                raise EOFError(f"the member at {start} is cut off")
            out.append(unzip.decompress(chunk))
            at += len(chunk)
        return b"".join(out), at - len(unzip.unused_data)


def records(file, size: int, start: int, end: int) -> Iterator[tuple]:
    """(offset, *WRITE_SCHEMA) of the records that start in [start, end)."""
    window, at = _Window(file, size), start
    while at < end:
        if not window.starts_record(at):
            found = window.find_record(at + 1 if window.read(at, 3) == MAGIC else at, end)
            if found is None:
                return
            at = found
        content, after = window.unpack(at)
        yield (at, *parse(content))
        at = after


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, path = file_system(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        out = []
        for f in files:
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and f.size:
                step = self.split or f.size
                out += [Range(f.path, a, min(a + step, f.size), f.size) for a in range(0, f.size, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.size:
            store, _ = file_system(self.path)
            with store.open_input_file(part.path) as file:
                for row in records(file, part.size, part.start, part.end):
                    yield (part.path, *row)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex[:12]

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        store, path = file_system(self.path)
        store.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        temporary, final = f"{path}/_{self.run}-{part}-{uuid.uuid4().hex}", f"{path}/part-{part:05d}-{self.run}.warc.gz"
        try:
            with store.open_output_stream(temporary) as out:
                for row in rows:
                    out.write(member(row))
        except BaseException:
            store.delete_file(temporary)
            raise
        return Written(temporary, final)

    def _leftovers(self, store, path) -> None:
        """Removes what attempts of this run have left that were not committed, as of lost executors."""
        from pyarrow import fs

        for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.run}-"):
                store.delete_file(f.path)

    def commit(self, messages) -> None:
        store, path = file_system(self.path)
        if self.overwrite:
            from pyarrow import fs

            for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.base_name.endswith(".warc.gz"):
                    store.delete_file(f.path)
        for m in messages:
            if m is not None:
                store.move(m.temporary, m.final)
        self._leftovers(store, path)

    def abort(self, messages) -> None:
        self._leftovers(*file_system(self.path))


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path) and df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


#: Payloads below this many bytes are always stored in full.
REVISIT_FROM = 1000


def urn(page_id):
    """A record id that carries a page id (null: an id of its own)."""
    low = F.lpad(F.lower(F.hex(page_id)), 16, "0")
    low = F.coalesce(low, F.lit("0" * 16))
    mark = F.when(page_id.isNull(), "ffffffff").otherwise("00000000")
    return F.concat(F.lit("urn:uuid:"), mark, F.lit("-0000-0000-"), F.substring(low, 1, 4), F.lit("-"), F.substring(low, 5, 12))


def page_of(urn_column):
    """The page id in urn()'s result."""
    half = lambda at, n: F.conv(F.substring(urn_column, at, n), 16, 10).cast("long")
    high, low = half(29, 4), half(34, 12)
    value = F.call_function("shiftleft", high, F.lit(48)).bitwiseOR(low)
    return F.when(F.substring(urn_column, 10, 8) == "00000000", value)


def as_records(pages: DataFrame) -> DataFrame:
    """Records of pages (page_id, url, html): equal large payloads become revisits of the largest page_id.

    The largest id of each digest is summed up before its shuffle; the join back is a plain equi-join, whose
    hot digests adaptive execution splits.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", payload.alias("payload"))
    p = p.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})
    alone = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    p = p.withColumn("same", F.when(F.col("payload_bytes") >= REVISIT_FROM, F.col("payload_digest")).otherwise(alone))
    full = p.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy("same").agg(F.max("page_id").alias("full_id"))
    p = p.join(full, "same", "left")
    revisit = F.col("full_id").isNotNull() & ~F.col("full_id").eqNullSafe(F.col("page_id"))
    return p.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, urn(F.col("full_id"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(WarcDataSource)
    rows.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("splitBytes", split_bytes).load(path)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(as_records(table(spark, sf_dir, "pages")), path)
    r = read_warc(spark, path, 4 << 20)
    return r.select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest AS d, max(page_id) AS full_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN full_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN full_id <> page_id THEN full_id END AS refers_to
FROM p LEFT JOIN m ON payload_bytes >= 1000 AND d = payload_digest
"""
