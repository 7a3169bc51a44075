"""Matching statistics: for each place of a pattern, the longest match with the collection that starts there, and where it occurs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators.suffixes import suffixes
from helixmill.plans.tables import running, stored
from helixmill.sources.sequences import numbered

#: Rows of an index that may be broadcast (24 bytes each).
BROADCAST_ROWS = 1 << 24


class Index:
    """A suffix array with BWT, LF and LCP as arrays; rows are suffix ranks."""

    def __init__(self, sa: np.ndarray, bwt: np.ndarray, lcp: np.ndarray):
        n = len(sa)
        self.sa, self.bwt, self.lcp = sa, bwt, lcp
        rank = np.empty(n, np.int64)
        order = np.argsort(sa, kind="stable")
        rank[order] = np.roll(order, 1)
        self.lf = rank  # the row of the text position before, cyclic
        self.jumps: list[tuple] = []  # (i, row before, row after, length) of the last walk's repositionings
        self.rows = {c: np.flatnonzero(bwt == c) for c in np.unique(bwt) if c != "$"}

    def _extension(self, a: int, b: int) -> int:
        """Common prefix of the suffixes of rows a < b."""
        return int(self.lcp[a + 1 : b + 1].min())

    def walk(self, pattern: str, on_bad: str = "error", recorded: dict[int, tuple[int, int]] | None = None) -> Iterator[tuple[int, int, int | None]]:
        """(i, length, row) from the right end to the left.

        The row is kept if its BWT has the wanted character; else the nearest row above or below that has it is taken,
        whichever shares more, above on ties. It starts in the last row. recorded has the row and the length of each such choice by i, as
        an earlier walk made them; they are followed then, and nothing is compared.
        """
        self.jumps.clear()
        last = len(self.sa) - 1
        row, length = last, 0
        for i in range(len(pattern) - 1, -1, -1):
            c = pattern[i]
            rows = self.rows.get(c)
            if rows is None:
                if on_bad == "error":
                    raise ValueError(f"{c!r} does not occur in the collection")
                row, length = last, 0
                yield i, 0, None
                continue
            if self.bwt[row] != c:
                self.jumps.append((i, row))
                if recorded is not None:
                    row, length = recorded[i]
                    self.jumps[-1] += (row, length)
                    row, length = int(self.lf[row]), length + 1
                    yield i, length, row
                    continue
                k = int(np.searchsorted(rows, row))
                up = self._extension(int(rows[k - 1]), row) if k else -1
                down = self._extension(row, int(rows[k])) if k < len(rows) else -1
                row, best = (int(rows[k - 1]), up) if up >= down else (int(rows[k]), down)
                length = min(length, best)
                self.jumps[-1] += (row, length)
            row, length = int(self.lf[row]), length + 1
            yield i, length, row

    def least(self, row: int, length: int) -> int:
        """The smallest text position among the suffixes that share length characters with row's."""
        lo = hi = row
        while self.lcp[lo] >= length and lo:
            lo -= 1
        while hi + 1 < len(self.sa) and self.lcp[hi + 1] >= length:
            hi += 1
        return int(self.sa[lo : hi + 1].min())


_MS = "name string, i long, len long, pos long"


def _rows(index: Index, name: str, pattern: str, rule: str, on_bad: str, recorded: dict[int, tuple[int, int]] | None = None) -> list[tuple]:
    return [(name, i, n, None if row is None else index.least(row, n) if rule == "min" else int(index.sa[row])) for i, n, row in index.walk(pattern, on_bad, recorded)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["name", "i", "len", "pos"])
    return out.astype({"i": "int64", "len": "int64", "pos": "Int64"})


def _index_of(table: DataFrame):
    """The broadcast arrays of a suffix table of up to BROADCAST_ROWS rows."""
    n = table.count()
    if n > BROADCAST_ROWS:
        raise ValueError(f"an index of {n} rows is too large to broadcast ({BROADCAST_ROWS}): use walks.walked or matched_by_order")
    arrays = table.select("sa_rank", "text_pos", "bwt", "lcp").toPandas().sort_values("sa_rank")
    return table.sparkSession.sparkContext.broadcast((arrays["text_pos"].to_numpy(np.int64), arrays["bwt"].to_numpy("<U1"), arrays["lcp"].to_numpy(np.int64)))


def repositionings(table: DataFrame, patterns: DataFrame, on_bad: str = "error") -> DataFrame:
    """(name, i, from_row, to_row, len): where the walk over a pattern left its row, for another with the wanted character, and the
    length it kept. Its count by name is the number of mismatches."""
    shared = _index_of(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value)
        for pdf in batches:
            for name, seq in zip(pdf["name"], pdf["seq"], strict=True):
                for _ in index.walk(seq or "", on_bad):
                    pass
                yield pd.DataFrame([(name, *j) for j in index.jumps], columns=["name", "i", "from_row", "to_row", "len"])

    return patterns.select("name", "seq").mapInPandas(run, "name string, i long, from_row long, to_row long, len long")


def matching_statistics(table: DataFrame, patterns: DataFrame, rule: str = "reference", on_bad: str = "error") -> DataFrame:
    """(name, i, len, pos) of each place of each pattern(name, seq), batch or streaming, by an index that is broadcast.

    table is a suffix table. pos is that of the walk's row ("reference") or the smallest ("min"). A character that the
    collection lacks raises, or with on_bad "break" gives len 0 and no pos. Rows of patterns are independent, so this
    also runs on a stream. The index may have BROADCAST_ROWS rows; beyond that, walks.walked gives the same without it.
    """
    shared = _index_of(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value)
        for pdf in batches:
            for name, seq in zip(pdf["name"], pdf["seq"], strict=True):
                yield _frame(_rows(index, name, seq or "", rule, on_bad))

    return patterns.select("name", "seq").mapInPandas(run, _MS)


def replayed(table: DataFrame, patterns: DataFrame, recorded: DataFrame, on_bad: str = "error") -> DataFrame:
    """(name, i, len, pos) by the walk, with its choices taken from recorded, the rows of repositionings(): what they chose is not looked for again."""
    shared = _index_of(table)
    made = recorded.groupBy("name").agg(F.collect_list(F.struct("i", "to_row", "len")).alias("made"))  # of one pattern: no more than its length
    rows = patterns.select("name", "seq").join(made, "name", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value)
        for pdf in batches:
            for name, seq, found in zip(pdf["name"], pdf["seq"], pdf["made"], strict=True):
                choices = {int(c["i"]): (int(c["to_row"]), int(c["len"])) for c in (found if found is not None else ())}
                yield _frame(_rows(index, name, seq or "", "reference", on_bad, choices))

    return rows.select("name", "seq", F.col("made")).mapInPandas(run, _MS)


def counters(ms: DataFrame, recorded: DataFrame) -> DataFrame:
    """(name, characters, mismatches, matched, longest) of each pattern: its length, how often the walk left its row, and the sum and the largest of its lengths."""
    own = ms.groupBy("name").agg(F.count("*").alias("characters"), F.sum("len").alias("matched"), F.max("len").alias("longest"))
    left = recorded.groupBy(F.col("name").alias("own")).agg(F.count("*").alias("n"))
    return own.join(left, F.col("name") == F.col("own"), "left").select("name", "characters", F.coalesce("n", F.lit(0)).alias("mismatches"), "matched", "longest")


def arrays(ms: DataFrame, patterns: DataFrame) -> DataFrame:
    """(name, lens, poss): a row per pattern, its lengths and positions in arrays in the order of its characters, as sinks.write_matching takes them."""
    rows = ms.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("i", "len", "pos"))).alias("m"))
    part = lambda c: F.coalesce(F.transform("m", lambda x: F.coalesce(x[c], F.lit(0))), F.array().cast("array<bigint>"))
    return patterns.select("name").join(rows, "name", "left").select("name", part("len").alias("lens"), part("pos").alias("poss"))


def lengths_by_order(sequences: DataFrame, names: DataFrame, mode: str = "dna") -> tuple[DataFrame, DataFrame]:
    """The suffix table of sequences and patterns(k, seq) together, in which pattern k is sequence k + their number, and (seq_id, off, sa_rank, l, row)
    of each place of a pattern: l is the length of its longest match, row the rank among the sequences' own suffixes of one that has it."""
    n = sequences.count()
    both = sequences.select("seq_id", "seq", "len").unionByName(names.select((F.col("k") + n).alias("seq_id"), "seq", F.length("seq").cast("long").alias("len")))
    table = suffixes(both, "auto", mode)
    own = F.col("seq_id") < n
    rows = table.select("sa_rank", "seq_id", "off", "text_pos", "lcp", F.when(own, 1).otherwise(0).alias("own"))
    rows = stored(running(rows, "sa_rank", "own", "group"), "order")
    # from a group's own first row on; the rows before the first group have none above
    asked = Window.partitionBy("group").orderBy("sa_rank")
    up = F.min(F.when(F.col("own") == 0, F.col("lcp"))).over(asked.rowsBetween(Window.unboundedPreceding, 0))
    down = F.min("lcp").over(asked.rowsBetween(1, Window.unboundedFollowing))
    after = rows.where("own = 1").select((F.col("group") - 1).alias("group"), F.col("lcp").alias("next"))
    found = rows.withColumn("up", F.when(F.col("group") > 0, up)).withColumn("down", down).where("own = 0").join(after, "group", "left")
    below = F.when(F.col("next").isNotNull(), F.least(F.col("next"), F.coalesce("down", "next")))
    found = found.withColumn("l", F.greatest(F.coalesce("up", F.lit(0)), F.coalesce(below, F.lit(0)))).where(F.col("off") >= 0)
    row = F.when(F.col("l") > 0, F.when(F.col("up") == F.col("l"), F.col("group") - 1).otherwise(F.col("group")))
    return table, stored(found.select("seq_id", "off", "sa_rank", "l", row.alias("row")), "lengths")


def matched_by_order(sequences: DataFrame, patterns: DataFrame, mode: str = "dna") -> DataFrame:
    """(name, i, len, pos) with the smallest pos, from the suffix order of sequences and patterns(name, seq) together; len 0 has no pos.

    The longest match of a pattern's suffix is with the nearest suffix of a sequence above or below it: the least LCP between. All
    matches of that length are neighbours. It is sorts, joins by place and running minima: no index in one place, and no bound on sizes.
    Names of patterns must differ.
    """
    n = sequences.count()
    names = stored(numbered(patterns), "patterns")
    table, found = lengths_by_order(sequences, names, mode)
    own = F.col("seq_id") < n
    # the smallest position among the suffixes that share l characters: least LCPs and positions of 2^k rows together
    place = F.when(own, F.col("text_pos"))
    above = table.select((F.col("sa_rank") + 1).alias("sa_rank"), place.alias("p"))
    levels = [stored(table.where("lcp >= 1").withColumn("q", place).join(above, "sa_rank").select(F.col("sa_rank").alias("at"), F.col("lcp").alias("low"), "p", "q"), "minima")]
    while not levels[-1].isEmpty():
        half = levels[-1]
        later = half.select((F.col("at") - (1 << (len(levels) - 1))).alias("at"), F.col("low").alias("low2"), F.col("p").alias("p2"), F.col("q").alias("q2"))
        levels.append(stored(half.join(later, "at").select("at", F.least("low", "low2").alias("low"), F.least("p", "p2").alias("p"), F.least("q", "q2").alias("q")), "minima"))
    at = found.where("l > 0").select("seq_id", "off", "l", F.col("sa_rank").alias("lo"), F.col("sa_rank").alias("hi"), F.lit(None).cast("long").alias("pos"))
    for k in reversed(range(len(levels) - 1)):
        step = 1 << k
        above = levels[k].select((F.col("at") + step - 1).alias("lo"), F.col("low").alias("up"), F.col("p"))
        under = levels[k].select((F.col("at") - 1).alias("hi"), F.col("low").alias("down"), F.col("q"))
        at = at.join(above, "lo", "left").join(under, "hi", "left")
        grows = lambda c: F.coalesce(F.col(c) >= F.col("l"), F.lit(False))
        at = stored(
            at.select(
                "seq_id", "off", "l", (F.col("lo") - F.when(grows("up"), step).otherwise(0)).alias("lo"), (F.col("hi") + F.when(grows("down"), step).otherwise(0)).alias("hi"),
                F.least("pos", F.when(grows("up"), F.col("p")), F.when(grows("down"), F.col("q"))).alias("pos"),
            ),
            "ranges",
        )
    at = at.select(F.col("seq_id").alias("s"), F.col("off").alias("o"), "pos")
    out = found.join(at, (F.col("seq_id") == F.col("s")) & (F.col("off") == F.col("o")), "left").withColumn("k", F.col("seq_id") - n)
    out = out.join(names.select("k", "name", F.length("seq").alias("size")), "k").where(F.col("off") < F.col("size"))
    return out.select("name", F.col("off").alias("i"), F.col("l").alias("len"), "pos")
