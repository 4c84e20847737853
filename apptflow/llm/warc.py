"""Dictionary-compressed WARC archives.

Every task writes its partition's pages as WARC records into archives of a
bounded size. The first records of an archive train a Zstandard dictionary,
which goes into a leading skippable frame; every record is then a frame of its
own, compressed with the dictionary, so that any record can be read alone. An
archive waits for at least ``LEAST_SAMPLES`` records, of long ones the beginnings
are trained on; only one whose records are fewer or too small has no dictionary.

Records with equal payloads are written once: the one with the largest
identifier is the response, the others are revisits that refer to it. Payloads
are grouped by SHA-256 with a pre-aggregated maximum; digests that more than
half a partition's share of the records have (at most two for each shuffle
partition) are broadcast, their records are spread by identifier.

Files go to the shared folder through pyarrow's file systems, under a name
with the attempt, and are renamed when complete: a repeated task replaces its
archive by one with the same records.

Defined results: null payloads count as empty; a null identifier is smaller
than any other and reads back as null; all rows that repeat the largest
identifier of a payload are responses. Control characters in a URL are escaped,
a null URL becomes one made of the identifier. An empty table writes nothing
and reads back no rows. Other columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptflow.llm.common import partitions
from apptflow.session import cut_lineage

# fixed values of the formats
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICT_BYTES = 64 * 1024
SAMPLE_BYTES = 8 * 1024 * 1024
#: records that a dictionary is trained on, at least; an archive waits for them
LEAST_SAMPLES = 8
ARCHIVE_BYTES = 256 * 1024 * 1024
RECORD_URI = "urn:x-page:"


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder's URI; a path without a scheme is local."""
    m = re.match(r"file:/+(.*)", uri)
    if m:
        return pyarrow.fs.LocalFileSystem(), "/" + m[1]
    if ":" not in uri.split("/")[0]:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The response record of a page or, with ``refers_to``, its revisit record.

    A revisit keeps the HTTP headers, and so the payload's length, not the payload.
    """
    name = "" if page_id is None else str(page_id)
    target = quote(url, safe="%:/?#[]@!$&'()*+,;=~-._") if url else f"{RECORD_URI}{name}"
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    headers = [("WARC-Record-ID", f"<{RECORD_URI}{name}>"), ("WARC-Target-URI", target), ("WARC-Date", date),
               ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
               ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return _record("response", headers, http + payload)
    headers += [("WARC-Refers-To", f"<{RECORD_URI}{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return _record("revisit", headers, http)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of what repeats in the records, of long ones in their beginnings; None for fewer than
    ``LEAST_SAMPLES`` records or where nothing repeats."""
    samples = [r[:SAMPLE_BYTES // LEAST_SAMPLES] for r in samples]
    size = min(size, sum(map(len, samples)) // 8)
    if len(samples) < LEAST_SAMPLES or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8)
    except zstandard.ZstdError:  # the trainer finds nothing that repeats
        return None


class ArchiveWriter:
    """Archives of one task: record after record, a new file when one is full."""

    def __init__(self, folder: str, part: int, attempt: int):
        self.folder = folder.rstrip("/")
        self.fs, self.root = file_system(self.folder)
        self.fs.create_dir(self.root, recursive=True)
        self.part, self.attempt, self.number = part, attempt, 0
        self.done: list[tuple[str, int, int]] = []
        self._new()

    def _new(self) -> None:
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.records = self.size = 0
        self.out = None

    def _open(self) -> None:
        name = f"part-{self.part:05d}-{self.number:04d}.warc.zst"
        self.name, self.temp = name, f"{self.root}/.{name}.{self.attempt}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        found = train_dictionary(self.waiting)
        if found is not None:
            raw = found.as_bytes()
            self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=found, write_content_size=True)
        info = b"software: apptflow\r\nformat: WARC File Format 1.1\r\n"
        self._frame(_record("warcinfo", [("WARC-Record-ID", f"<urn:x-archive:{name}>"),
                                         ("Content-Type", "application/warc-fields")], info))
        for r in self.waiting:
            self._frame(r)
        self.waiting = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _frame(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.out is None:
            self.waiting.append(record)
            self.waiting_bytes += len(record)
            if self.waiting_bytes >= SAMPLE_BYTES and len(self.waiting) >= LEAST_SAMPLES:
                self._open()
            return
        self._frame(record)
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if not self.records:
            return
        if self.out is None:
            self._open()
        self.out.close()
        self.fs.move(self.temp, f"{self.root}/{self.name}")
        self.done.append((f"{self.folder}/{self.name}", self.records, self.size))
        self.number += 1
        self._new()


def _with_decision(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """page_id, url, payload and refers_to: the response's identifier for revisits, else null."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    d = d.withColumn("sha", F.sha2("payload", 256))
    n, parts = pages.count(), partitions(pages.sparkSession)
    groups = (d.filter(F.octet_length("payload") >= least).groupBy("sha")
              .agg(F.count("*").alias("size"), F.max("page_id").alias("response")).filter("size > 1"))
    groups = cut_lineage(groups)
    is_hot = F.col("size") * 2 * parts > max(n, 2 * parts)
    hot = groups.filter(is_hot).select(F.col("sha").alias("hot_sha"), F.col("response").alias("hot_response"))
    rest = groups.filter(~is_hot).select(F.col("sha").alias("key"), "response")
    d = d.join(F.broadcast(hot), d["sha"] == hot["hot_sha"], "left")  # fewer than 2 * parts rows
    d = d.withColumn("key", F.when(F.col("hot_sha").isNull(), F.col("sha"))
                     .otherwise(F.concat(F.lit("hot "), F.xxhash64("page_id").cast("string"))))
    d = d.join(rest, "key", "left").withColumn("response", F.coalesce("hot_response", "response"))
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return d.select("page_id", "url", "payload", F.when(revisit, F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least_revisit_bytes: int = 0,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page below ``folder``; the archives written: path, records, bytes."""
    d = _with_decision(pages, id_col, url_col, payload_col, least_revisit_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out = ArchiveWriter(folder, task.partitionId(), task.taskAttemptId())
        for batch in batches:
            ids, urls, payloads, refers = batch.columns
            for i in range(len(batch)):
                out.add(page_record(ids[i].as_py(), urls[i].as_py(), payloads[i].as_py(), refers[i].as_py(), date))
        out.close()
        cols = list(zip(*out.done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                                          pa.array(cols[2], pa.int64())], names=["path", "records", "bytes"])

    # a record for each archive; kept, so that reading the list does not write again
    return cut_lineage(d.mapInArrow(write, "path string, records long, bytes long"))


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    magic = stream.read(8)
    found = None
    if len(magic) == 8 and struct.unpack("<II", magic)[0] == SKIPPABLE_MAGIC:
        found = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", magic)[1]))
        magic = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=found)
    raw = _Rest(magic, stream)
    with decompressor.stream_reader(raw, read_across_frames=True) as plain:
        text = io.BufferedReader(plain, 1 << 20)
        while line := text.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            headers = {}
            while (line := text.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().partition(":")
                headers[k.lower()] = v.strip()
            block = text.read(int(headers["content-length"]))
            if text.read(4) != b"\r\n\r\n":
                raise ValueError("a WARC record is cut short")
            yield headers, block


class _Rest(io.RawIOBase):
    """What is left of a stream after its first bytes were read."""

    def __init__(self, first: bytes, stream: io.BufferedIOBase):
        self.first, self.stream = first, stream

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if self.first:
            out, self.first = self.first, b""
            return out
        return self.stream.read(n)


def _number(uri: str) -> int | None:
    digits = uri.strip("<>").removeprefix(RECORD_URI)
    return int(digits) if digits else None


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page
    record; a response whose payload does not have its digest is an error."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with file_system(path)[0].open_input_stream(file_system(path)[1], compression=None) as f:
                    for headers, block in read_records(f):
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"{path}: {headers['warc-record-id']} does not have its digest")
                        rows.append((_number(headers["warc-record-id"]), size, digest, kind,
                                     _number(headers["warc-refers-to"]) if kind == "revisit" else None))
                        if len(rows) >= 10_000:
                            yield as_batch(rows)
                            rows = []
        yield as_batch(rows)

    # an archive a task, spread over all tasks: a few paths may lie in one partition of the list
    n = max(1, min(archives.count(), partitions(archives.sparkSession)))
    return archives.select("path").repartition(n, F.xxhash64("path")).mapInArrow(read, schema)
