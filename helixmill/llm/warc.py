"""WARC archives, written and read as a chunked record table.

A record is a gzip member of its own. Reading gives rows (record, chunk number): a payload is never held whole, each
row has at most CHUNK bytes of it, the number of bytes so far and the SHA-1 of all bytes so far. The last chunk's is
that of the payload, and is held against the record's header.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import flagged, join_hot, new_folder, slices, stored
from helixmill.llm.records import files_of

#: Bytes of a chunk; bytes of an archive, after which another is begun; payloads from this length on are kept once.
CHUNK, ARCHIVE, LEAST_SHARED = 1 << 18, 64 << 20, 1000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f2c1a52-3a0c-5d53-9a6b-2f9f0a1f7b11")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def base32_of(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


class ArchiveWriter:
    """Writes records to archives in a folder; begins another when one has ARCHIVE bytes."""

    def __init__(self, folder: str, most: int = ARCHIVE):
        self.folder, self.most, self.out, self.written, self.done = folder, most, None, 0, []
        self.fs, self.at = files_of(folder)
        self.fs.create_dir(self.at, recursive=True)
        self.date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def _open(self) -> None:
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.out, self.written = self.fs.open_output_stream(f"{self.at}/{name}", buffer_size=1 << 20), 0
        self.done.append([f"{self.folder}/{name}", 0])

    def add(self, page_id: int | None, url: str | None, payload: memoryview | bytes, digest: str, refers_to: int | None, size: int | None = None) -> None:
        """A response, or a revisit of the page refers_to, which needs the size of its payload alone; a payload goes through the compressor in pieces."""
        if self.out is None or self.written >= self.most:
            self.close()
            self._open()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
        revisit = refers_to is not None
        head = [
            "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {self.date}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_of(digest)}", f"Content-Length: {len(http) + (0 if revisit else len(payload))}",
        ]
        if page_id is not None:
            head.append(f"X-Page-ID: {page_id}")
        if url is not None:
            head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
        if revisit:
            head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
        press = zlib.compressobj(1, zlib.DEFLATED, 31)
        view = memoryview(b"" if revisit else payload)
        for part in ("\r\n".join([*head, "", ""]).encode() + http, *(view[i : i + CHUNK] for i in range(0, len(view), CHUNK)), b"\r\n\r\n"):
            self._write(press.compress(part))
        self._write(press.flush())
        self.done[-1][1] += 1

    def _write(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.written += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _headers(f: io.BufferedIOBase, path: str) -> tuple[str, dict[str, str]] | None:
    """The first line and the fields up to an empty line; None at the end of the file."""
    first = f.readline()
    if not first:
        return None
    fields = {}
    while (line := f.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError(f"{path}: cut off in a header")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return first.decode("utf-8", "replace").strip(), fields


def read_chunks(path: str, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunk rows of an archive, in order; one chunk in memory at a time. A payload without bytes has one empty chunk."""
    fs, at = files_of(path)
    with fs.open_input_stream(at, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as f:
        while (head := _headers(f, path)) is not None:
            if not head[0].startswith("WARC/"):
                raise ValueError(f"{path}: a record begins with {head[0][:20]!r}")
            fields, left = head[1], int(head[1]["content-length"])
            http = io.BytesIO(f.read(min(left, 1 << 16))) if fields["warc-type"] == "revisit" else f
            before = f.tell()
            _, own = _headers(http, path)
            left = 0 if http is not f else left - (f.tell() - before)
            page, of = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
            row = {"page_id": None if page is None else int(page), "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "refers_to": None if of is None else int(of)}
            stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
            if http is not f:  # the payload is elsewhere: its length and digest are those that the record states
                yield row | {"chunk": 0, "data": b"", "bytes_so_far": int(own["content-length"]), "sha1_so_far": stated, "last": True}
            else:
                digest, n, k = hashlib.sha1(), 0, 0
                while True:
                    data = f.read(min(chunk, left))
                    if len(data) < min(chunk, left):
                        raise ValueError(f"{path}: cut off in a payload")
                    left -= len(data)
                    n += len(data)
                    digest.update(data)
                    if not left and digest.hexdigest() != stated:
                        raise ValueError(f"{path}: {row['record_id']} fails its digest")
                    yield row | {"chunk": k, "data": data, "bytes_so_far": n, "sha1_so_far": digest.hexdigest(), "last": not left}
                    k += 1
                    if not left:
                        break
            if f.read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: a record doesn't end where it says")


_ROWS = "page_id long, record_id string, record_type string, refers_to long, chunk long, data binary, bytes_so_far long, sha1_so_far string, last boolean"


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least_shared: int = LEAST_SHARED) -> DataFrame:
    """Writes a record per row of pages and returns the stored table (path, n_records) of its archives.

    The payload is the html in UTF-8 (null or empty: no bytes). Of equal payloads of least_shared bytes or more, rows with the
    largest page_id are responses and the others revisits of it. A null page_id is the least; if a payload has no
    other, its rows are responses. Shorter payloads are all responses. A null url is left out; repeated rows are records each. Equal payloads
    are found by their SHA-1, without the texts; only rows whose digest more than one page_id may have are shuffled, and those of
    a digest that a large share of the pages has stay where they are. A very long payload is one cell of the table, and is
    compressed in pieces. Other columns are not read, whatever their names. An empty table gives no archive.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("size"), F.sha1(body.cast("binary")).alias("digest"))
    shared = rows.where(F.col("size") >= least_shared).groupBy("digest").agg(F.max("page_id").alias("of"), F.min(F.struct("page_id")).alias("least"), F.count("*").alias("n"))
    shared = stored(shared.where("of is not null and not (least.page_id <=> of)").select("digest", "of", "n"), "shared")
    rows = flagged(rows, "digest", shared, "digest", "maybe")
    names = ("page_id", "url", "html", "size", "digest")
    total = shared.agg(F.sum("n")).first()[0] or 0
    same = join_hot(rows.where("maybe").select(*names), shared, "digest", "n", total, "left")
    same = same.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("of")), F.col("of"))).withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit("")))
    rows = rows.where("not maybe").select(*names, F.lit(None).cast("long").alias("refers_to")).unionByName(same.select(*names, "refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ArchiveWriter(folder)
        for batch in slices(batches, "html"):
            ids, urls, _, sizes, digests, of = (c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns))
            for k, payload in enumerate(batch.column(2)):
                out.add(ids[k], urls[k], payload.as_buffer(), digests[k], of[k], sizes[k])
        out.close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in out.done], pa.string()), "n_records": pa.array([d[1] for d in out.done], pa.int64())})

    return stored(rows.mapInArrow(run, "path string, n_records long"), "archives")


def read_archives(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of all archives: a row per record and chunk. Without with_data, data is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _ROWS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in read_chunks(path):
                    rows.append(row if with_data else row | {"data": None})
                    size += len(row["data"]) + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(run, _ROWS)


def payloads(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, from its last chunk."""
    return chunks.where("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to")
