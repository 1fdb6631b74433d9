"""WARC archives as chunked record tables: written and read as streams of (record, chunk number) rows."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import LAST_ID, new_path, ordered_id, write_table

CHUNK = 1 << 16
SMALLEST_REVISIT = 100
_CHUNK = pa.schema(
    [("rid", pa.int64()), ("did", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("running_sha256", pa.string()),
     ("last", pa.bool_()), ("size", pa.int64()), ("digest", pa.string())]
)
_CHUNK_TYPES = "rid long, did long, url string, chunk_no int, chunk binary, running_sha256 string, last boolean, size long, digest string"
_READ = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("chunk_bytes", pa.int64()), ("running_sha256", pa.string()),
     ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size_of: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most 4096 rows, or about 4 MB in the binary column size_of."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[size_of] or b"")
        if len(held) >= 4096 or size >= 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _views(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of every row of a string column where they lie; nothing is copied. Nulls are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    whole = memoryview(data) if data is not None else memoryview(b"")
    for a, b, valid in zip(ends, ends[1:], column.is_valid().to_pylist()):
        yield whole[a:b] if valid else memoryview(b"")


def record_chunks(pages: DataFrame, chunk_bytes: int = CHUNK, payloads: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The chunk table of a page table: rid (one a row of pages), did, url, chunk_no, chunk, running_sha256, last, size, digest.

    Each payload is passed over in place, chunk_bytes at a time, and every chunk carries the SHA-256 of all bytes up to
    its end; size and digest are those of the whole record. Time is linear in the payload. An empty payload is one
    empty chunk. Without payloads only the last chunk of a record is given, without its bytes.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), ordered_id(id_col).alias("did"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def chunks(batch: pa.RecordBatch) -> Iterator[tuple]:
        for rid, did, url, payload in zip(*[batch.column(i).to_pylist() for i in range(3)], _views(batch.column(3))):
            so_far, running = hashlib.sha256(), []
            for at in range(0, max(1, len(payload)), chunk_bytes):
                so_far.update(payload[at : at + chunk_bytes])
                if payloads:
                    running.append(so_far.hexdigest())
            digest = so_far.hexdigest()
            if payloads:
                for number, sha in enumerate(running):
                    chunk = payload[number * chunk_bytes : (number + 1) * chunk_bytes].tobytes()
                    yield rid, did, url, number, chunk, sha, number + 1 == len(running), len(payload), digest
            else:
                yield rid, did, url, (max(1, len(payload)) - 1) // chunk_bytes, None, digest, True, len(payload), digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _in_batches(chunks(batch), _CHUNK, 4)

    return rows.mapInArrow(run, _CHUNK_TYPES)


def revisits(records: DataFrame) -> DataFrame:
    """(did, digest, first) of the records (did, size, digest) whose payload a smaller id has too; first is the smallest.

    Copies are counted before they are shuffled, and the way back joins (did, digest) pairs, of which a payload that very
    many pages share has as many as ids; the join splits them if they are skewed.
    """
    known = records.where(F.col("size") >= SMALLEST_REVISIT)
    first = known.groupBy("digest").agg(F.min("did").alias("first"), F.max("did").alias("most")).where("first < most").select("digest", "first")
    return known.select("did", "digest").distinct().join(first, "digest").where("did > first").select("did", "digest", "first")


def _header(did: int, url: str | None, digest: str, size: int, first: int | None) -> bytes:
    revisit = first is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{did} {url} {digest}')}>"),
        ("WARC-Target-URI", "".join((url or "").split())), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", "" if did == LAST_ID else str(did)), ("X-Payload-Length", str(size)),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(first))]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", "0" if revisit else str(size))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def write_archives(chunks: DataFrame, path: str, level: int = 1) -> DataFrame:
    """Writes chunk rows (rid, did, url, digest, size, first, chunk_no, chunk, running_sha256, last) as .warc.gz files, a
    gzip member for each record, and returns (path, records).

    Rows of a record are dealt to one partition and sorted; each task streams them into one file, chunk by chunk, so it
    holds a chunk and never a record. The digest that it carries along has to be that of the last chunk. A file's name has the
    task attempt's id: of attempts that are repeated, only the one whose row is kept is listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/part-{TaskContext.get().taskAttemptId():08d}-{uuid.uuid4().hex}.warc.gz"
        out = member = so_far = None
        records = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for did, url, digest, size, first, number, chunk, running, last in zip(*[c.to_pylist() for c in part.columns]):
                    if out is None:
                        system, where = _filesystem(name)
                        system.create_dir(where.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(where, compression=None)
                    if number == 0:
                        if member is not None:
                            out.write(member.compress(b"\r\n\r\n") + member.flush())
                        member, so_far = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha256()
                        out.write(member.compress(_header(did, url, digest, size, first)))
                        records += 1
                    if first is None and chunk:
                        so_far.update(chunk)
                        out.write(member.compress(chunk))
                    if first is None and last and so_far.hexdigest() != running:
                        raise ValueError(f"chunks of {did} are out of order or missing")
        if out is not None:
            out.write(member.compress(b"\r\n\r\n") + member.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["path", "records"])

    dealt = chunks.sortWithinPartitions("rid", "chunk_no").select("did", "url", "digest", "size", "first", "chunk_no", "chunk", "running_sha256", "last")
    return write_table(dealt.mapInArrow(run, "path string, records long"), "warc-files")


class _Members:
    """Bytes of a file of gzip members, as they are asked for."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.inflate, self.ready, self.left = stream, zlib.decompressobj(31), bytearray(), b""

    def more(self) -> bool:
        if self.inflate.eof:
            self.left, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        data = self.inflate.unconsumed_tail or self.left or self.stream.read(CHUNK)
        self.left = b""
        if data:
            self.ready += self.inflate.decompress(data, CHUNK)
        return bool(data)

    def line(self) -> bytes:
        while (end := self.ready.find(b"\r\n")) < 0:
            if not self.more():
                return b""
        out = bytes(self.ready[:end])
        del self.ready[: end + 2]
        return out

    def read(self, n: int) -> bytes:
        while len(self.ready) < n and self.more():
            pass
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def at_end(self) -> bool:
        while not self.ready:
            if not self.more():
                return True
        return False


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The chunk table of the archives that column path lists.

    Every file is read by a task of its own, as a stream. One row per record and chunk: the bytes (if payloads), the SHA-256 of all bytes so far, and on a record's
    `last` chunk its full length and digest. Records without a body, such as revisits, have one chunk; their
    length and digest are those of the full payload, from the header. A response whose bytes don't have the
    digest of its header stops the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, where = _filesystem(name)
                with system.open_input_stream(where, compression=None) as stream:
                    yield from _in_batches(rows(_Members(stream)), _READ, 6)

    def rows(source: _Members) -> Iterator[tuple]:
        while not source.at_end():
            if source.line() != b"WARC/1.1":
                raise ValueError("not a WARC record")
            head = {}
            while line := source.line():
                key, _, value = line.decode().partition(":")
                head[key.lower()] = value.strip()
            page, refers = head["x-page-id"], head.get("x-refers-to-page")
            same = (head["warc-record-id"], int(page) if page else None, head["warc-target-uri"], head["warc-type"], int(refers) if refers else None)
            body, size, digest = int(head["content-length"]), int(head["x-payload-length"]), head["warc-payload-digest"].partition(":")[2]
            so_far, number, done = hashlib.sha256(), 0, 0
            while True:
                chunk = source.read(min(CHUNK, body - done))
                if len(chunk) < min(CHUNK, body - done):
                    raise ValueError("the archive ends within a record")
                done += len(chunk)
                so_far.update(chunk)
                last = done == body
                if last and head["warc-type"] == "response" and (so_far.hexdigest() != digest or done != size):
                    raise ValueError(f"{same[0]} does not have its header's digest")
                yield *same, number, chunk if payloads else None, len(chunk), so_far.hexdigest(), last, size if last else None, digest if last else None
                number += 1
                if last:
                    break
            if source.read(4) != b"\r\n\r\n":
                raise ValueError("a record has no end")

    schema = "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, chunk binary, chunk_bytes long, running_sha256 string, last boolean, payload_bytes long, payload_digest string"
    return files.select("path").repartition(max(1, files.count())).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row of pages to path (a new folder of the shared one by default) and lists the files.

    Null html is an empty payload. A null id counts as the largest. Rows with the smallest id of their payload are
    responses, also if the row is repeated. Other columns are ignored; no rows give no files.
    """
    path = path or new_path(pages.sparkSession, "warc")
    columns = {"id_col": id_col, "url_col": url_col, "html_col": html_col}
    again = write_table(revisits(record_chunks(pages, payloads=False, **columns)), "revisits")
    joined = record_chunks(pages, **columns).join(again, ["did", "digest"], "left").where("first IS NULL OR chunk_no = 0")
    return write_archives(joined.withColumn("chunk", F.when(F.col("first").isNull(), F.col("chunk"))), path)


def digests(files: DataFrame) -> DataFrame:
    """One row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_archives(files, payloads=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
