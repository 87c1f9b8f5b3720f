"""WARC archives in Zstandard: a writer and a reader.

An archive is: a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself
compressed, then one frame for each record. The reader loads the dictionary from that
leading frame, decodes frame by frame as it streams the file, and validates every
record: version line, required headers, the block's length against Content-Length, the
closing blank lines, and the payload's digest. An archive without a leading skippable
frame is read without a dictionary.

Of pages with equal payloads of at least MIN_REVISIT bytes, the one with the smallest
page_id is written as a response, the others as revisits that refer to it (profile
identical-payload-digest, without the payload; the HTTP headers keep its length).
Which digests repeat is found by an aggregation with map-side combining; only that list
of repeated digests is joined back, and Spark broadcasts it only if its stored size is
below the session's threshold.

Tasks write their archives to the shared folder under names of their own (partition and
attempt), rename them when complete, and report them in a manifest that Spark commits;
files of lost attempts are in no manifest and are never read.

Defined cases: a null html is an empty payload; pages with a null url have no
target URI; pages with a null page_id are never referred to, but may revisit; rows that
repeat the smallest page_id of a payload are responses all; an empty table gives no
archive and an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm.common import open_store, shared_path, stored, table

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 2 << 20
SAMPLE_RECORD = 16 << 10
DICT_BYTES = 64 << 10
LEVEL = 3
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"

#: Fixed values of the formats.
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
ZSTD_FRAME = (0xFD2FB528).to_bytes(4, "little")
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
RECORD_URN = "urn:x-page:"


class InvalidArchive(ValueError):
    """A frame, a header or a length is not as the format has it."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def http_length(self) -> int:
        for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                return int(value)
        raise InvalidArchive("the HTTP headers have no Content-Length")


def record_bytes(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join([*lines, b"", block, b"", b""])


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{RECORD_URN}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    headers.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<{RECORD_URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    headers.append(("Content-Type", HTTP))
    return record_bytes(headers, http if refers_to is not None else http + payload)


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of a bounded sample; None if the sample is too small to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples) if len(samples) >= 8 else None
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Streams records into one archive; the first SAMPLE_BYTES of them train its dictionary."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.level, self.held, self.size = out, level, [], 0
        self.packer: zstandard.ZstdCompressor | None = None
        self.records = self.raw = 0

    def write(self, record: bytes) -> None:
        self.records += 1
        self.raw += len(record)
        if self.packer:
            self.out.write(self.packer.compress(record))
            return
        self.held.append(record)
        self.size += len(record)
        if self.size >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        dictionary = train([r[:SAMPLE_RECORD] for r in self.held])
        if dictionary:
            frame = zstandard.ZstdCompressor(level=self.level).compress(dictionary.as_bytes())
            self.out.write(SKIPPABLE + len(frame).to_bytes(4, "little") + frame)
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for r in self.held:
            self.out.write(self.packer.compress(r))
        self.held = []

    def finish(self) -> None:
        if not self.packer:
            self._begin()


def read_dictionary(source) -> tuple[zstandard.ZstdCompressionDict | None, bytes]:
    """(dictionary, bytes read beyond it) of an open archive."""
    head = source.read(4)
    if head != SKIPPABLE:
        return None, head
    n = int.from_bytes(source.read(4), "little")
    frame = source.read(n)
    if len(frame) != n:
        raise InvalidArchive("the dictionary's frame is cut short")
    if frame[:4] == ZSTD_FRAME:
        frame = zstandard.ZstdDecompressor().decompressobj().decompress(frame)
    return zstandard.ZstdCompressionDict(frame), b""


def read_frames(source) -> Iterator[bytes]:
    """The content of each frame after the dictionary's."""
    dictionary, rest = read_dictionary(source)
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while rest or (rest := source.read(READ_BYTES)):
        frame, parts = unpacker.decompressobj(), []
        try:
            parts.append(frame.decompress(rest))
            while not frame.eof:
                more = source.read(READ_BYTES)
                if not more:
                    raise InvalidArchive("the last frame is cut short")
                parts.append(frame.decompress(more))
        except zstandard.ZstdError as error:
            raise InvalidArchive(f"a frame can't be decoded: {error}") from error
        rest = frame.unused_data
        yield b"".join(parts)


def parse_record(data: bytes) -> Record:
    """One record, validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        raise InvalidArchive(f"not a WARC record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise InvalidArchive(f"bad header line {line[:80]!r}")
        headers[name.strip().decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise InvalidArchive(f"the header {name} is missing")
    size = headers["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise InvalidArchive(f"Content-Length {size} does not fit a block of {len(rest) - 4} bytes")
    record = Record(headers, rest[:-4])
    if headers["warc-type"] == "response" and "warc-payload-digest" in headers:
        if headers["warc-payload-digest"] != f"sha256:{hashlib.sha256(record.payload()).hexdigest()}":
            raise InvalidArchive("the payload's digest does not fit")
        if record.http_length() != len(record.payload()):
            raise InvalidArchive("the payload's length does not fit its HTTP header")
    if headers["warc-type"] == "revisit" and not {"warc-refers-to", "warc-profile", "warc-payload-digest"} <= headers.keys():
        raise InvalidArchive("a revisit lacks what it refers to")
    return record


def read_archive(source) -> Iterator[Record]:
    for data in read_frames(source):
        yield parse_record(data)


def resolve_revisits(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, payload, digest, refers_to)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_ = rows.where(F.octet_length("payload") >= MIN_REVISIT)
    firsts = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = stored(firsts.select("digest", "first"), "warc-repeats")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write a record for each page; returns the committed manifest: rows (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        writer = file = name = None

        def close() -> None:
            writer.finish()
            file.close()
            store.move(f"{root}/{name}.part", f"{root}/{name}")
            done.append((f"{folder}/{name}", writer.records))

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst"
                    file = store.open_output_stream(f"{root}/{name}.part", compression=None)
                    writer = ArchiveWriter(file)
                writer.write(page_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], date))
                if writer.raw >= ARCHIVE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return stored(resolve_revisits(pages).mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the archives in column path."""

    def page(urn: str | None) -> int | None:
        name = (urn or "").strip("<>").removeprefix(RECORD_URN)
        return int(name) if name else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            n = 6 if with_payload else 5
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(n)], names[:n])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = open_store(path)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as source:
                    for r in read_archive(source):
                        h = r.headers
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
                        body = r.payload() if with_payload and h["warc-type"] == "response" else None
                        rows.append((page(h["warc-record-id"]), r.http_length(), digest, h["warc-type"], page(h.get("warc-refers-to")), body))
                        size += len(body or b"")
                        if len(rows) >= 10_000 or size >= READ_BYTES * 16:
                            yield packed(rows)
                            rows, size = [], 0
                yield packed(rows)

    spark = manifest.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("path").repartition(tasks, "path").mapInArrow(run, schema + (", payload binary" if with_payload else ""))


def write_one(records: Iterable[bytes]) -> bytes:
    """An archive in memory (for tests and small tools)."""
    out = io.BytesIO()
    writer = ArchiveWriter(out)
    for r in records:
        writer.write(r)
    writer.finish()
    return out.getvalue()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return read_archives(manifest)


SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
