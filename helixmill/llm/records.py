"""Token ids as length-delimited binary records, with an offset index.

A shard is a file of frames: the length of the payload (8 bytes, little-endian), its masked CRC-32, the payload, the payload's
masked CRC-32. A payload is a flag byte (1: doc_id is null), the doc_id (8 bytes) and the ids, in 2 bytes each if the vocabulary has
at most 2**16 ids, else in 4; the shard's name says which. The index beside a shard has a fixed-size row per record:
its offset, its number of ids, its doc_id. So records can be read in any order without the shard being scanned.
The checksum is the CRC-32 of zlib, masked by a rotation and a constant so that a checksum of checksums is no fixed point.
"""

from __future__ import annotations

import io
import random
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.chunks import Memory
from helixmill.llm.common import new_folder, slices, stored

#: Fixed value of the mask.
_MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_ID = struct.Struct("<Bq")
_ROW = struct.Struct("<QQBq")
INDEX = np.dtype([("offset", "<u8"), ("n", "<u8"), ("null", "u1"), ("doc_id", "<i8")])

Encoder = Callable[[pa.Array], list[np.ndarray]]


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def files_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Frames records into one shard and its index; at most one payload and the index rows are in memory."""

    def __init__(self, folder: str, name: str, dtype: str):
        self.fs, at = files_of(folder)
        self.fs.create_dir(at, recursive=True)
        self.path, self.index_path = f"{folder}/{name}.{dtype}.rec", f"{folder}/{name}.{dtype}.idx"
        self.out = self.fs.open_output_stream(f"{at}/{name}.{dtype}.rec", buffer_size=1 << 20)
        self.index_out = self.fs.open_output_stream(f"{at}/{name}.{dtype}.idx", buffer_size=1 << 16)
        self.dtype, self.offset, self.records, self.ids = np.dtype(dtype), 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        payload = _ID.pack(doc_id is None, doc_id or 0) + ids.astype(self.dtype, copy=False).tobytes()
        length = struct.pack("<Q", len(payload))
        frame = b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))])
        self.out.write(frame)
        self.index_out.write(_ROW.pack(self.offset, len(ids), doc_id is None, doc_id or 0))
        self.offset, self.records, self.ids = self.offset + len(frame), self.records + 1, self.ids + len(ids)

    def close(self) -> None:
        self.out.close()
        self.index_out.close()


def _frame(f, path: str) -> bytes | None:
    head = f.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError(f"{path}: cut off in a length")
    length, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError(f"{path}: a length fails its checksum")
    body = f.read(length + 4)
    payload = body[:length]
    if len(body) < length + 4 or masked(payload) != struct.unpack("<I", body[length:])[0]:
        raise ValueError(f"{path}: a payload fails its checksum or is cut off")
    return payload


def _record(payload: bytes, path: str) -> tuple[int | None, np.ndarray]:
    null, doc_id = _ID.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, path.rsplit(".", 2)[1], offset=_ID.size)


def read_shard(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of a shard in order, one in memory at a time; every checksum is tested."""
    fs, at = files_of(path)
    with fs.open_input_stream(at, buffer_size=1 << 20) as raw:
        f = io.BufferedReader(raw, 1 << 20)
        while (payload := _frame(f, path)) is not None:
            yield _record(payload, path)


def read_shuffled(path: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of a shard in a seeded order, by its index."""
    fs, at = files_of(path.removesuffix(".rec") + ".idx")
    with fs.open_input_stream(at) as f:
        index = np.frombuffer(f.read(), INDEX)
    order = list(range(len(index)))
    random.Random(seed).shuffle(order)
    fs, at = files_of(path)
    with fs.open_input_file(at) as f:
        for k in order:
            f.seek(int(index["offset"][k]))
            yield _record(_frame(f, path), path)


class ChunkEncoder:
    """Ids by the tokenizers library for tokenizers that lower-case, drop white space and never merge letters with marks.

    Texts are cut at spaces and line feeds; an ASCII word and the marks behind it are cut as well. Equal chunks, and equal
    parts of new chunks, are encoded once for as long as they are remembered.
    """

    MARKS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        self.chunks, self.parts = Memory(self._bytes, most=500_000), Memory(self._bytes, most=500_000)

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def _cut(self, chunk: str) -> tuple[str, ...]:
        if chunk.isascii():
            if chunk.isalpha():
                return (chunk.lower(),)
            word = chunk.rstrip(self.MARKS)
            if word.isalpha():
                return word.lower(), chunk[len(word) :]
        return (chunk,)

    def _learn(self, wanted: list[str]) -> list[bytes]:
        """The ids of each of some distinct chunks."""
        chunks, parts, longest = self.chunks, self.parts, self.chunks.longest
        known, before = chunks.get, chunks.old.get
        out = list(map(known, wanted))
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i in missing:
            out[i] = before(wanted[i])
        cuts = {i: self._cut(wanted[i]) for i in missing if out[i] is None}
        new = list(set(chain.from_iterable(cuts.values())).difference(parts).difference(parts.old))
        made = {p: self._bytes(e.ids) for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)}
        old, young, find = parts.old, parts.get, made.get

        def ids_of(p: str) -> bytes:
            ids = find(p)
            if ids is None:
                ids = young(p)
                if ids is None:
                    ids = made[p] = old[p]
            return ids

        for i, cut in cuts.items():
            out[i] = ids_of(cut[0]) if len(cut) == 1 else ids_of(cut[0]) + ids_of(cut[1])
        if len(parts) + len(made) > parts.most:
            parts.turn()
        parts.update((p, ids) for p, ids in made.items() if len(p) <= longest)
        if len(chunks) + len(missing) > chunks.most:
            chunks.turn()
        chunks.update((c, out[i]) for i in missing if len(c := wanted[i]) <= longest)
        return out

    def __call__(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of each text. Arrow cuts the texts and numbers their distinct chunks; numpy puts the ids together."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not pc.any(pc.match_substring(column, "<|")).as_py():
            column = pc.ascii_lower(column)  # as the tokenizer does; special tokens are left to it
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        ids = self._learn(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        pool, first = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(size) - size
        at = coded.indices.to_numpy()
        size = size[at]
        end = np.concatenate([[0], np.cumsum(size)])
        flat = pool[np.repeat(first[at] - end[:-1], size) + np.arange(end[-1])]
        bounds = end[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@cache
def chunk_encoder(path: str, dtype: str) -> ChunkEncoder:
    """One for each Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkEncoder(path, dtype)


def write_records(docs: DataFrame, encoder: Callable[[], Encoder], end_id: int, vocabulary: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of every whole text and end_id behind them, in order of doc_id, and returns the shards.

    Shards are ranges of doc_id, each sorted by its own task. A task writes files of its own name; a task that is
    run again writes others, and only those of the task that ended well are in the result, which is a stored
    table of (shard, path, n_records, n_ids, start): start counts the ids of all shards before. A null text
    counts as the empty one, null doc_ids come first, equal doc_ids by their text; repeated rows are records each. A very long text
    is encoded whole and is one record. Other columns are not read, whatever their names. An empty table gives no shard.
    """
    folder = folder or new_folder(docs.sparkSession, "records")
    dtype = "uint16" if vocabulary <= 1 << 16 else "uint32"
    key = F.col("doc_id").asc_nulls_first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode, out = TaskContext.get().partitionId(), encoder(), None
        for batch in slices(batches, "text", 16 << 20):
            out = out or ShardWriter(folder, f"{shard:06d}-{uuid.uuid4().hex}", dtype)
            for d, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                out.add(d, np.append(ids, np.array([end_id], ids.dtype)))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [out.path], "n_records": [out.records], "n_ids": [out.ids]})

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = texts.repartitionByRange(key).sortWithinPartitions(key, F.col("text").asc_nulls_first())
    shards = stored(dealt.mapInArrow(run, "shard long, path string, n_records long, n_ids long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per record
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_records(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the shards: start counts the ids before it, and the
    checksum is that of its ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for d, ids in read_shard(path):
                    rows.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    n = shards.count()
    return shards.select("path", "start").repartition(max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
