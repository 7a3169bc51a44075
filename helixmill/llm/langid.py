"""Language identification by language-bitmask n-gram filters.

A Bloom filter of masks holds all languages at once: each of its cells is a bit mask of languages, and an n-gram of a
language sets that language's bit in each of its cells. The conjunction of an n-gram's cells gives at once
all languages that contain it. Per language, the n-grams of a text that it contains are counted (the
popcounts of the bit slices), the count is corrected for the filter's false positives, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import mix, slices, texts_of

#: Documents of each language that are learned from: those with the smallest hashes of their text and doc_id.
SAMPLE = 400
#: Characters of each of them.
SAMPLE_CHARS = 4000
#: Languages of one mask; more of them take further masks a cell.
MASK = 64
#: Languages whose samples are learned from at a time.
TOGETHER = 64
#: Sizes of n-grams, in characters, and how many of the most frequent n-grams of each size a language keeps.
SIZES = (2, 3, 4)
KEPT = {2: 300, 3: 1200, 4: 3000}
CELLS, PROBES = 1 << 18, 2

_U = np.uint64


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters as one space, one at either end."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le"), "<u4")
    kept = _letters()[points]
    keep = kept.copy()
    keep[1:] |= kept[:-1]  # the first of each run of others stays, as a space
    out = np.where(kept, points, 32)[keep]
    if not len(out):
        return out
    return np.concatenate([[32] if out[0] != 32 else [], out, [32] if out[-1] != 32 else []]).astype(np.uint32)


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each run of n code points; 21 bits a code point, mixed beyond three."""
    with np.errstate(over="ignore"):
        total = np.full(max(0, len(points) - n + 1), n, _U)
        for i in range(n):
            total = total * _U(0x1FFFFFFFFFFFFFC5) + points[i : len(points) - n + 1 + i]
    return total


def _cells(g: np.ndarray) -> list[np.ndarray]:
    h = mix(g)
    return [((h >> _U(24 * i)) & _U(CELLS - 1)).astype(np.int64) for i in range(PROBES)]


def best_grams(texts: list[str]) -> np.ndarray:
    """The KEPT most frequent n-grams of each size (ties: the smaller number)."""
    points, best = [letters(t) for t in texts], []
    for n in SIZES:
        found, count = np.unique(np.concatenate([grams(t, n) for t in points]), return_counts=True)
        best.append(found[np.lexsort((found, -count))[: KEPT[n]]])
    return np.concatenate(best)


class Filter:
    """The filter, its languages, and per size of n-gram the share of false positives of each language."""

    def __init__(self, languages: list[str], cells: np.ndarray):
        """cells: CELLS masks, or a row of CELLS masks for each MASK languages."""
        self.languages, self.cells = languages, cells
        self.words = [(row, min(MASK, len(languages) - MASK * i)) for i, row in enumerate(np.atleast_2d(cells)) if len(languages) > MASK * i]
        bits = np.array([(row >> row.dtype.type(k) & row.dtype.type(1)).mean() for row, size in self.words for k in range(size)])
        self.false = bits**PROBES

    @classmethod
    def learned(cls, rows: list[tuple[str, str]]) -> Filter:
        """From (language, text). Each language keeps its most frequent n-grams of each size (ties: the smaller number)."""
        of: dict[str, list[str]] = {}
        for lang, t in rows:
            of.setdefault(lang, []).append(t)
        return cls.of_best({lang: best_grams(texts) for lang, texts in of.items()})

    @classmethod
    def of_best(cls, best: dict[str, np.ndarray]) -> Filter:
        """From the n-grams that each language keeps."""
        languages = sorted(best)
        dtype = next((t for t in (np.uint8, np.uint16, np.uint32) if np.dtype(t).itemsize * 8 >= len(languages)), np.uint64)
        cells = np.zeros((max(1, -(-len(languages) // MASK)), CELLS), dtype)
        for k, lang in enumerate(languages):
            for c in _cells(best[lang]):
                np.bitwise_or.at(cells[k // MASK], c, dtype(1 << k % MASK))
        return cls(languages, cells[0] if len(cells) == 1 else cells)

    def shares(self, points: np.ndarray) -> np.ndarray:
        """Per language, the share of the text's n-grams that it contains, corrected for false positives; the mean over sizes."""
        out, sizes = np.zeros(len(self.languages)), 0
        for n in SIZES:
            g = grams(points, n)
            if not len(g):
                continue
            sizes += 1
            at = _cells(g)
            hits = np.concatenate([self._hits(np.bitwise_and.reduce([row[c] for c in at]), size) for row, size in self.words])
            out += np.clip((hits / len(g) - self.false) / (1 - self.false), 0, 1)
        return out / max(sizes, 1)

    def _hits(self, mask: np.ndarray, size: int) -> np.ndarray:
        if mask.dtype == np.uint8:
            return np.bincount(mask, minlength=256) @ _SLICES[:, :size]
        return np.array([np.count_nonzero(mask & mask.dtype.type(1 << k)) for k in range(size)])

    def predict(self, text: str) -> tuple[str, float]:
        points = letters(text)
        if not len(points) or not self.languages:
            return "und", 0.0
        shares = self.shares(points)
        best = int(np.argmax(shares))  # ties: the first language by name
        total = shares.sum()
        return self.languages[best], float(shares[best] / total) if total > 0 else 1 / len(self.languages)


_SLICES = (np.arange(256)[:, None] >> np.arange(8)) & 1


def learn(docs: DataFrame, labelled: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Filter:
    """A filter from a bounded sample of the labelled rows: sample documents of each language, SAMPLE_CHARS characters each.

    Which documents those are depends on hashes of their text and doc_id alone, so it is the same in every run; a repeated row counts once.
    All languages are learned, TOGETHER of them at a time, so the driver holds TOGETHER * sample * SAMPLE_CHARS characters
    at most, besides the kept n-grams of each language.
    """
    # rows that are equal have equal hashes: one of them stays, so no list grows with them
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text), F.col(doc_id)).alias("h"), labelled.alias("of")).where("of and lang is not null and length(text) > 0")
    # Few of the documents of a language stay after its threshold hash; what stays is ranked exactly.
    counts = rows.select("lang", "h").distinct().groupBy("lang").count().orderBy("lang").collect()
    kept: dict[str, np.ndarray] = {}
    for i in range(0, len(counts), TOGETHER):
        limit = F.create_map(*(x for r in counts[i : i + TOGETHER] for x in (F.lit(r[0]), F.lit(min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, (2 * sample + 100) / r[1])))))))
        some = rows.withColumn("most", F.element_at(limit, F.col("lang"))).where("h <= most").select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text")).dropDuplicates(["lang", "h"])
        best = some.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "text"))), 1, sample).alias("rows"))
        kept |= {r["lang"]: best_grams([x["text"] for x in r["rows"]]) for r in best.collect()}
    return Filter.of_best(kept)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the doc_id as text leaves 2 on division by 4. A null doc_id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every whole text.

    lang_pred is a language learned from the rows that are not held out; und (score 0) if the text is null or has
    no letter, or nothing could be learned. score is the share of the best among all languages' corrected counts; of equal ones the first by
    name is taken. Predictions read the text alone, a very long one whole. Rows with a null doc_id are held out; repeated rows get equal
    results. Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    found = learn(docs, ~held_out(F.col(doc_id)), doc_id, text, lang)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((found.languages, found.cells))  # CELLS cells of 8 bytes for each MASK languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Filter(*shared.value)
        for batch in slices(batches, "text"):
            out = [model.predict(t) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
