"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue, and decoding.

A pre-token's bytes are the nodes of a linked list. Every pair of neighbours that the vocabulary can merge waits in the
bucket of its rank. Bitmaps in two levels say which buckets hold anything, leaves of 256 bits and one above them with a
bit a leaf: find-first-set at each level gives the lowest rank. Positions of a bucket are taken from left to right; an entry whose pair has changed
since is stale and skipped. Every merge removes a node and adds two entries at most, so a
pre-token of n bytes takes O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.chunks import SINGLE_SPACE, Memory
from helixmill.llm.common import slices, texts_of


#: Chunks and pre-tokens that a worker remembers, in each of two generations: about 300 MB in all.
REMEMBER = 400_000

class ByteBPE:
    """Encoding and decoding by a file of ranks: a line per token, its bytes in base64 and its rank, which is its id."""

    def __init__(self, path: str, pattern: str, remember: int = REMEMBER):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {v: k for k, v in self.ranks.items()}
        # the queue; empty again after each pre-token, so that one serves them all
        self.buckets: dict[int, list[int]] = {}
        self.leaves = [0] * ((max(self.bytes) >> 8) + 1)
        self.bits = [1 << i for i in range(max(256, len(self.leaves)))]
        # white space as the property of that name, which is what the pattern's library means by \s
        stated = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(stated).findall
        self.tokens = Memory(self._token, most=remember)
        self.first = Memory(self._chunk)
        self.after_space = Memory(lambda chunk: None if not chunk or chunk[0].isspace() or chunk[-1].isspace() else self._chunk(" " + chunk), most=remember)

    def merge(self, token: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, buckets, leaves, bits = self.ranks, self.buckets, self.leaves, self.bits
        find = ranks.get
        if (whole := find(token, -1)) >= 0:
            return [whole]
        n = len(token)
        part = [token[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # the rank of a live node and its successor
        top = 0  # which leaves hold a bit; a leaf holds a bit for each rank with a bucket
        for i in range(n - 1):
            if (r := find(token[i : i + 2], -1)) >= 0:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)  # ascending, so a heap
                else:
                    buckets[r] = [i]
                    w = r >> 8
                    leaves[w] |= bits[r & 255]
                    top |= bits[w]
        while top:
            w = (top & -top).bit_length() - 1
            leaf = leaves[w]
            r = w << 8 | (leaf & -leaf).bit_length() - 1
            bucket = buckets[r]
            while bucket:
                i = heappop(bucket)
                if pair[i] != r:
                    continue  # stale
                j = after[i]
                own = part[i] = part[i] + part[j]
                pair[j] = -1
                k = after[i] = after[j]
                x = y = -1
                if k < n:
                    before[k] = i
                    x = find(own + part[k], -1)
                pair[i] = x
                if x >= 0:
                    if x in buckets:
                        heappush(buckets[x], i)
                    else:
                        buckets[x] = [i]
                        leaves[x >> 8] |= bits[x & 255]
                        top |= bits[x >> 8]
                if (h := before[i]) >= 0:
                    y = pair[h] = find(part[h] + own, -1)
                    if y >= 0:
                        if y in buckets:
                            heappush(buckets[y], h)
                        else:
                            buckets[y] = [h]
                            leaves[y >> 8] |= bits[y & 255]
                            top |= bits[y >> 8]
                if 0 <= x < r or 0 <= y < r:
                    break
            if not bucket:
                del buckets[r]
                leaves[w] ^= bits[r & 255]
                if not leaves[w]:
                    top ^= bits[w]
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def _token(self, token: str) -> bytes:
        return np.array(self.merge(token.encode()), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return self.tokens[chunk]
        return b"".join([self.tokens[t] for t in self.split(chunk)])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self.first[first] + b"".join(map(self.after_space.__getitem__, rest))
            except TypeError:  # white space next to a space: cut only where that is safe
                pass
        chunks = SINGLE_SPACE.split(text)
        return self.first[chunks[0]] + b"".join([self.first[" " + c] for c in chunks[1:]])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def loaded(path: str, pattern: str, remember: int = REMEMBER) -> ByteBPE:
    """One for each Python worker."""
    return ByteBPE(path, pattern, remember)


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", remember: int = REMEMBER) -> DataFrame:
    """(doc_id, ids binary, decoded binary): the ids of every whole text, and the bytes that they decode to.

    A null text counts as the empty one, with no ids; a very long text is encoded whole, and so is a very long pre-token. A null doc_id stays
    null. Rows are independent: repeated rows give repeated results, an empty table an empty one; other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern, remember)
        for batch in slices(batches, "text"):
            ids = [bpe.encode(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encoding_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", remember: int = REMEMBER) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded(), made in the same pass, so ids need not leave the worker.

    Nulls, empty and very long texts, repeated rows, other columns and empty tables as there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern, remember)
        for batch in slices(batches, "text"):
            n, a, b = [], [], []
            for t in texts_of(batch.column(1)):
                ids = bpe.encode(t)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"n_tokens": n, "ids_sha256": a, "decoded_sha256": b}), preserve_index=False).add_column(0, "doc_id", batch.column(0))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
