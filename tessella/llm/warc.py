"""WARC archives: an index first, then coalesced range reads of the selected records."""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import new_path, pick, written

#: Records closer than this in a file are fetched by one read; a read is at most ``READ_BYTES`` (or one record).
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20
#: Compressed bytes that a task fetches, about, and that are worth a task of their own where cores are idle.
TASK_BYTES, LEAST_BYTES = 16 << 20, 1 << 20
#: A file is indexed and read in pieces of this many bytes of compressed data.
_BUFFER = 1 << 20
_INDEX = "file string, offset long, length long, url string, digest string, record_id string"
_DAMAGED = "file string, offset long, length long"
_RECORDS = "file string, offset long, url string, record_id string, digest string, payload binary"
_MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """A header value: white space and control characters, which no URL may hold, are percent-encoded."""
    return "".join("".join(f"%{b:02X}" for b in c.encode()) if c.isspace() or ord(c) < 32 or 127 <= ord(c) < 160 else c for c in value)


def record(record_id: str, url: str | None, payload: bytes) -> bytes:
    """A gzip member with one response record."""
    block = _HTTP + payload
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:record:{_clean(record_id)}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += ["WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip(" \t")
    length = headers.get("content-length", "")
    block = rest[: int(length)] if length.isdigit() else b""
    if "msgtype=response" in headers.get("content-type", "") or block.startswith(b"HTTP/"):
        block = block.partition(b"\r\n\r\n")[2]
    return headers, block


def _entry(headers: dict[str, str], payload: bytes) -> tuple[str | None, str, str | None]:
    digest = headers.get("warc-payload-digest") or "sha256:" + hashlib.sha256(payload).hexdigest()
    name = headers.get("warc-record-id", "")
    name = name[len("<urn:record:") : -1] if name.startswith("<urn:record:") else name.strip("<>")
    return headers.get("warc-target-uri"), digest, name


def _write(path: str, batches):
    task = TaskContext.get()
    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
    system, root = _filesystem(path)
    n = 0
    with system.open_output_stream(f"{root}/{name}", compression=None) as out:
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if html is not None:
                    out.write(record("" if page_id is None else str(page_id), url, html.encode("utf-8", "replace")))
                    n += 1
    yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([n], pa.int64())], ["file", "n"])


def write_warc(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write one compressed archive for each partition and return (file, n) of them.

    A null html was not captured and has no record; a null url has no target header, and white
    space and control characters in one are percent-encoded.  A lost
    attempt's file is in no row.  Repeated pages have records of their own.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    system, root = _filesystem(path)
    system.create_dir(root, recursive=True)
    files = pick(pages, "page_id", "url", "html").mapInArrow(partial(_write, path), "file string, n long")
    return written(files, "warc-files").where("n > 0")


def _members(stream):
    """(offset, length, raw) of each gzip member; ``raw`` is None for one that is damaged.  After
    damage the search goes on at the next place that looks like the start of a member.  A cut-off
    last member is left out."""
    start, buffer = 0, b""
    while True:
        inflate, parts, seen = zlib.decompressobj(31), [], []
        try:
            while not inflate.eof:
                if not buffer and not (buffer := stream.read(_BUFFER)):
                    return
                seen.append(buffer)
                parts.append(inflate.decompress(buffer))
                buffer = inflate.unused_data
            length = sum(map(len, seen)) - len(buffer)
            yield start, length, b"".join(parts)
        except zlib.error:
            rest, length = b"".join(seen), 0
            while (at := rest.find(_MAGIC, 0 if length else 1)) < 0:
                if not (more := stream.read(_BUFFER)):
                    yield start, length + len(rest), None
                    return
                gone = max(0, len(rest) - len(_MAGIC) + 1)
                length, rest = length + gone, rest[gone:] + more
            yield start, length + at, None
            length, buffer = length + at, rest[at:]
        start += length


def _scan(damaged: bool, batches):
    for batch in batches:
        for file in batch.column("file").to_pylist():
            rows = []
            system, path = _filesystem(file)
            with system.open_input_stream(path, compression=None) as stream:
                for offset, length, raw in _members(stream):
                    if damaged:
                        if raw is None:
                            rows.append((file, offset, length))
                        continue
                    headers, payload = parse(raw or b"")
                    if headers.get("warc-type") in ("response", "resource"):
                        rows.append((file, offset, length, *_entry(headers, payload)))
                    if len(rows) >= 4096:
                        yield _batch(rows, _INDEX)
                        rows = []
            if rows:
                yield _batch(rows, _DAMAGED if damaged else _INDEX)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _by_file(files: DataFrame) -> DataFrame:
    return files.select("file").repartition(max(1, files.count()), "file")


def index_warc(files: DataFrame) -> DataFrame:
    """(file, offset, length, url, digest, record_id) of each response or resource record in the
    archives of ``files`` (file), as a written table.  Damaged members and a cut-off last record
    are left out; ``damaged_members`` tells of the former."""
    return written(_by_file(files).mapInArrow(partial(_scan, False), _INDEX), "warc-index")


def damaged_members(files: DataFrame) -> DataFrame:
    """(file, offset, length) of the stretches of archives that aren't whole gzip members."""
    return _by_file(files).mapInArrow(partial(_scan, True), _DAMAGED)


def _fetch(gap_bytes: int, read_bytes: int, batches):
    rows, run = [], []

    def read():
        system, path = _filesystem(run[0][0])
        first, last = run[0][1], max(o + n for _, o, n in run)
        with system.open_input_file(path) as source:
            data = source.read_at(last - first, first)
        for file, offset, length in run:
            headers, payload = parse(zlib.decompress(data[offset - first : offset - first + length], 31))
            url, digest, name = _entry(headers, payload)
            rows.append((file, offset, url, name, digest, payload))
        run.clear()

    for batch in batches:
        for item in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
            if run and (item[0] != run[0][0] or item[1] > run[-1][1] + run[-1][2] + gap_bytes or item[1] + item[2] - run[0][1] > read_bytes):
                read()
                if len(rows) >= 256:
                    yield _batch(rows, _RECORDS)
                    rows = []
            run.append(item)
    if run:
        read()
    if rows:
        yield _batch(rows, _RECORDS)


def read_records(selected: DataFrame, gap_bytes: int = GAP_BYTES, read_bytes: int = READ_BYTES) -> DataFrame:
    """(file, offset, url, record_id, digest, payload) of the index rows in ``selected``.

    Rows are brought together by stretches of a file and sorted by offset; neighbours at most
    ``gap_bytes`` apart are fetched by one read of at most ``read_bytes``.  The number of tasks
    follows the bytes to read, not those of the index.  Each index row, a repeated one too, gives
    a record; an empty index none.
    """
    near = selected.select("file", "offset", "length", F.expr(f"offset div {read_bytes * 4}").alias("stretch"))
    size = near.agg(F.sum("length")).first()[0] or 0
    tasks = max(1 + size // TASK_BYTES, min(selected.sparkSession.sparkContext.defaultParallelism, 1 + size // LEAST_BYTES))
    ordered = near.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")
    return ordered.mapInArrow(partial(_fetch, gap_bytes, read_bytes), _RECORDS)


def distinct_pages(pages: DataFrame, path: str | None = None, **reading) -> DataFrame:
    """(page_id, url, digest, html): each distinct content once, read back from archives.

    The pages are archived and indexed; of the records with equal digests the one of the least
    (page_id, url) is selected, nulls last, and only the selected ones are read.  A null html
    has no record; an empty one is content like any other.  Of repeated pages one remains.  Very
    long pages are records like others; an empty table gives no rows.  Other columns don't matter.
    White space and control characters of a url come back percent-encoded.  The choice is a
    partial minimum, so a content that a third of all pages have is no hot key.
    """
    index = index_warc(write_warc(pages, path))
    number = F.expr("try_cast(record_id as long)")
    place = F.struct(number.isNull().alias("no"), number.alias("id"), F.col("url").isNull().alias("none"), "url", "file", "offset", "length")
    chosen = written(index.groupBy("digest").agg(F.min(place).alias("m")).select("m.file", "m.offset", "m.length"), "warc-chosen")
    found = read_records(chosen, **reading)
    return found.select(F.expr("try_cast(record_id as long)").alias("page_id"), "url", F.expr("substring_index(digest, ':', -1)").alias("digest"), F.col("payload").cast("string").alias("html"))
