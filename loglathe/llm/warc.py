"""WARC archives with an index: one gzip member per record, byte ranges of selected records read back in order.

Writing deals the pages to tasks; each task writes archive files of bounded size into a folder that all executors share and
returns one index row per record: file, offset, length, URL and digest. The index is a table that Spark commits, so files
of failed attempts are never referred to. Of pages with equal payloads the one with the smallest id is written whole, the
others as revisit records that refer to it. Reading sorts the index rows of the selected records by file and offset, joins
neighbouring ranges into one read, and parses the members.

Cases: a null page is empty. Empty payloads are compared like others. Repeated rows with the smallest id are all written
whole. A null id never is the smallest one, unless all of the group are null; those are then all written whole. A null or
broken URL is percent-encoded where a header could not hold it. Extra columns are ignored. An empty table gives an empty
index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe import session

DATE = "1970-01-01T00:00:00Z"  # the pages carry no time of their own
FILE_BYTES = 64 << 20  # a file is closed beyond this
MIN_REVISIT_BYTES = 0  # smaller payloads are always written whole
GAP_BYTES = 64 << 10  # a gap up to this is read along
TASK_BYTES = 16 << 20  # archive bytes that a task reads, about
READ_BYTES = 8 << 20  # most bytes joined into one read
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "path string, offset long, length long, url string, digest string, page_id long, record_type string"
_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _open(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri)


def _header_text(value: str) -> str:
    """A header value without what would end the line."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id, url: str, payload: bytes, refers_to=None, revisit: bool = False) -> tuple[bytes, str]:
    """One WARC record (uncompressed) and its bare payload digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _header_text(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n", digest


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one record; raises when it is cut short."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or not head.startswith(b"WARC/"):
        raise ValueError("broken record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class _Writer:
    """Archive files of one task."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.fs, self.base = _open(self.folder)
        context = TaskContext.get()
        self.name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        self.count, self.out, self.offset = 0, None, 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.count += 1
            self.file = f"{self.name}-{self.count:04d}.warc.gz"
            self.out, self.offset = self.fs.open_output_stream(f"{self.base}/{self.file}", compression=None), 0
        self.out.write(data)
        at = (f"{self.folder}/{self.file}", self.offset, len(data))
        self.offset += len(data)
        if self.offset > FILE_BYTES:
            self.close()
        return at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def decided(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The pages with what each refers to: the smallest id among equal payloads, null for those written whole.

    The id per digest is aggregated before its shuffle, and a digest with very many pages is split by the skew join.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first_id"))
    again = ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.octet_length("payload") >= min_bytes)
    return rows.join(first, "sha1").select(
        "page_id", "url", "payload", again.alias("revisit"), F.when(again, F.col("first_id")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives and their index; returns the index as a stored table."""
    spark = pages.sparkSession
    folder = folder or session.run_folder(spark, "warc")
    files = f"{folder}/files"
    fs, base = _open(files)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(files)
        for batch in batches:
            rows = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "revisit", "refers_to"))):
                data, digest = record(r[0], r[1], r[2], r[4], r[3])
                rows.append((*writer.add(_member(data)), r[1], digest, r[0], "revisit" if r[3] else "response"))
            columns = list(zip(*rows)) if rows else [[] for _ in _INDEX_NAMES]
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types)], names=_INDEX_NAMES)
        writer.close()

    decided(pages).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) joined into reads: start, end, and the records inside."""
    run: list[tuple[int, int]] = []
    end = 0
    for offset, length in rows:
        if run and (offset - end > GAP_BYTES or max(end, offset + length) - run[0][0] > READ_BYTES):
            yield run[0][0], end, run
            run = []
        run.append((offset, length))
        end = max(end, offset + length) if len(run) > 1 else offset + length
    if run:
        yield run[0][0], end, run


RECORDS = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long"
)
_RECORD_NAMES = [c.split()[0] for c in RECORDS.split(", ")]


def read(selected: DataFrame) -> DataFrame:
    """The records of the selected index rows; the payload of a revisit is null, its size and digest are the full ones'."""
    rows = selected.select("path", "offset", "length")
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # by the bytes to read, as the index itself is far smaller than what it points to
    tasks = max(1, -(-total // TASK_BYTES))
    dealt = rows.repartition(tasks, "path").sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            by_path: dict[str, list[tuple[int, int]]] = {}
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                by_path.setdefault(path, []).append((offset, length))
            for path, rows in by_path.items():
                fs, name = _open(path)
                with fs.open_input_file(name) as source:
                    for start, end, inside in ranges(rows):
                        data = source.read_at(end - start, start)
                        found = [_record_row(data[o - start : o - start + n]) for o, n in inside]
                        columns = [pa.array(list(c), type=t) for c, t in zip(zip(*found), types)]
                        yield pa.RecordBatch.from_arrays(columns, names=_RECORD_NAMES)

    return dealt.mapInArrow(run, RECORDS)


def _record_row(data: bytes) -> tuple:
    fields, http, payload = parse(zlib.decompress(data, 31))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("payload does not match its digest")
    return (
        _page(fields["WARC-Record-ID"]),
        fields["WARC-Target-URI"],
        None if revisit else payload,
        int(http["Content-Length"]),
        digest,
        fields["WARC-Type"],
        _page(fields["WARC-Refers-To"]) if revisit else None,
    )


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def scan(paths: DataFrame) -> DataFrame:
    """Index of archives that came without one: each file (column `path`) is walked once, member by member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for offset, data, length in _members(path):
                    page_id, url, _, _, digest, kind, _ = _record_row(data)
                    rows.append((path, offset, length, url, digest, page_id, kind))
                if rows:
                    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    arrays = [pa.array(list(c), type=t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(arrays, names=_INDEX_NAMES)

    return paths.select("path").repartition("path").mapInArrow(run, INDEX)


def _members(path: str, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes, int]]:
    """Offset, bytes and length of each gzip member."""
    fs, name = _open(path)
    with fs.open_input_stream(name, compression=None) as source:
        offset, held, unpacker, fed = 0, b"", zlib.decompressobj(31), bytearray()
        while data := held or source.read(chunk):
            held = b""
            unpacker.decompress(data)
            if not unpacker.eof:
                fed += data
                continue
            held = unpacker.unused_data
            fed += data[: len(data) - len(held)]
            yield offset, bytes(fed), len(fed)
            offset, unpacker, fed = offset + len(fed), zlib.decompressobj(31), bytearray()
