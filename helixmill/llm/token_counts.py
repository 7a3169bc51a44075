"""Token counts by rank-synchronous array merging.

The text's chunks are held as ragged arrays of symbols. In every round, each sequence merges all pairs of its own lowest rank at
the same time, for all sequences at once in numpy; what survives is counted. No symbol of the vocabulary has a space behind another
character, so no merge reaches across the space that starts a chunk, and equal chunks are counted once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import slices, texts_of

_NONE = np.int32(np.iinfo(np.int32).max)
_SPACED = re.compile(" *[^ ]+| +")


class PieceCounter:
    """Counts as a sentencepiece BPE model with byte fallback does, with identity normalization and a space put in front."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i).replace("▁", " "): model.get_score(i) for i in usable}
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece has a space behind another character; chunks would not be independent")
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        names = list(dict.fromkeys([*pieces, *chain.from_iterable(pieces)]))
        ids = {p: i for i, p in enumerate(names)}
        self.symbol = np.full(0x110000, -1, np.int32)  # of a character
        self.weight = np.ones(0x110000, np.int8)  # tokens that a character makes if nothing merges it
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        points = np.arange(0x110000)
        size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        known = np.zeros(0x110000, bool)
        known[[ord(p) for p in pieces if len(p) == 1]] = True
        self.weight[~known] = size[~known]
        self.n = len(names)
        pairs = [(ids[p[:k]] * self.n + ids[p[k:]], order[s], ids[p]) for p, s in pieces.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, t) for x, t in zip(zip(*pairs, strict=True), (np.int64, np.int32, np.int32), strict=True))
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair of symbols; _NONE if they don't merge."""
        key = a.astype(np.int64) * self.n + b
        key[(a < 0) | (b < 0)] = -1
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), self.merged[at]

    def count(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk, which stands behind a space of its own."""
        points = np.frombuffer(" ".join(["", *chunks]).encode("utf-32-le"), "<u4").astype(np.int32)
        lengths = np.array([len(c) + 1 for c in chunks])
        total = np.zeros(len(chunks), np.int64)
        sym, weight = self.symbol[points], self.weight[points].astype(np.int32)
        seq = np.repeat(np.arange(len(chunks)), lengths)
        last = np.ones(len(seq), bool)
        last[:-1] = seq[1:] != seq[:-1]
        rank, product = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(~last)
        rank[inner], product[inner] = self._pairs(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.ones(len(seq), bool)
            first[1:] = last[:-1]
            starts = np.flatnonzero(first)
            number = np.cumsum(first) - 1
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            if done.any():  # what survives is counted, and leaves
                np.add.at(total, seq[starts[done]], np.add.reduceat(weight, starts)[done])
                stay = ~done[number]
                sym, weight, seq, last, rank, product = (x[stay] for x in (sym, weight, seq, last, rank, product))
                if not len(sym):
                    break
                first, number, least = first[stay], (np.cumsum(~done) - 1)[number[stay]], least[~done]
            hit = rank == least[number]
            at = np.flatnonzero(hit)
            # of pairs that overlap, the first, third, ... of a run
            new_run = np.ones(len(at), bool)
            new_run[1:] = (at[1:] != at[:-1] + 1) | first[at[1:]]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            # A merge may give a pair of lower rank, which comes before the merges to the right of it.
            made = product[at]
            n = len(sym)
            after_pair = np.zeros(n + 1, bool)
            after_pair[at + 2] = True
            left = np.where(first[at], -1, sym[at - 1])
            merged_before = after_pair[at] & ~first[at]
            left[merged_before] = made[np.flatnonzero(merged_before) - 1]
            right = np.where(last[at + 1], -1, sym[np.minimum(at + 2, n - 1)])
            bad = np.minimum(self._pairs(left, made)[0], self._pairs(made, right)[0]) < least[number[at]]
            if bad.any():
                earlier = np.cumsum(bad) - bad
                base = earlier[np.searchsorted(number[at], number[at])]
                ok = earlier == base  # no bad merge to the left in the same sequence
                at, made = at[ok], made[ok]
            sym[at], weight[at], last[at] = made, 1, last[at + 1]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            at = place[at]
            sym, weight, seq, last, rank, product = (x[keep] for x in (sym, weight, seq, last, rank, product))
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[changed] = _NONE
            changed = changed[~last[changed]]
            rank[changed], product[changed] = self._pairs(sym[changed], sym[changed + 1])
        return total

    #: Chunks that a worker remembers, in each of two generations, and their longest.
    MOST, LONGEST = 300_000, 256

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        cut = []
        for t in texts:
            t = t.replace("▁", " ") if "▁" in t else t
            if not t:
                cut.append([])
            elif "  " in t or t[0] == " " or t[-1] == " ":
                cut.append([c[1:] for c in _SPACED.findall(" " + t)])
            else:
                cut.append(t.split(" "))
        wanted = set(chain.from_iterable(cut))
        if len(self.young) + len(wanted) > self.MOST:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        missing = [c for c in wanted if c not in known]
        found = {c: old[c] for c in missing if c in old}
        fresh = [c for c in missing if c not in found]
        long = {}
        if fresh:
            made = dict(zip(fresh, self.count(fresh).tolist(), strict=True))
            long = {c: made.pop(c) for c in fresh if len(c) > self.LONGEST}
            found |= made
        known |= found
        return [sum(map((known | long if long and not long.keys().isdisjoint(c) else known).__getitem__, c)) for c in cut]


@cache
def loaded(path: str) -> PieceCounter:
    """One for each Python worker."""
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every whole text.

    A null text counts as the empty one: 0 bytes, 0 tokens. A very long text is counted whole; it is in memory alone, as arrays. A null
    doc_id stays null. Repeated rows are counted alike, other columns are not read, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in slices(batches, "text", 2 << 20):
            texts = texts_of(batch.column(1))
            n = np.array(counter.counts(texts), np.int64)
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
