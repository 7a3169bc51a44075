"""Matching statistics by the walk over an index, without an index in one place.

A step of the walk depends on its row and the next character alone: if the row is not in a run of that character, the run above or below is taken, and
which of them changes at one row between the two, the last least LCP there (its threshold). So a step is an as-of join with the runs in order of character and threshold.

Steps need not be taken one after the other from the right end. Where a match gets shorter, all rows that share the match step to the same one, so any of them
may stand for the walk's: the lengths and such a row come from the suffix order of collection and patterns together. Walks begin
at all these places at once. From each, texts are compared to the left as far as they agree, in one go; only where they differ within a match, the
walk chooses another row, and that is a round of jobs. There are as many rounds as the most such choices within one match, however long patterns are.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.strings import common_prefix
from helixmill.operators.matching import lengths_by_order
from helixmill.operators.runs import by_letter
from helixmill.operators.suffixes import PIECE, pieces
from helixmill.plans.tables import as_of, range_size, stored
from helixmill.sources.sequences import numbered

#: Bits for a place in a range of rows (tables.RANGE_ROWS), below an lcp.
_BITS = 20
_POSITION = ("text_pos", "seq_id", "off")
_LOCAL = "part long, ch string, first_row long, last_row long, top struct<text_pos: long, seq_id: long, off: long>, bottom struct<text_pos: long, seq_id: long, off: long>, head boolean, tail boolean, gap long, gap_at long, rest long, rest_at long, whole long, whole_at long"


def _least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least key of each range from lo to hi, both included, by tables of 2^k neighbours; no range is empty."""
    out, level = np.empty(len(lo), np.int64), key
    widths = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1  # the largest power of two that fits
    for k in range(int(widths.max(initial=-1)) + 1):
        at = np.flatnonzero(widths == k)
        out[at] = np.minimum(level[lo[at]], level[hi[at] - (1 << k) + 1])
        level = np.minimum(level[: len(level) - (1 << k)], level[1 << k :]) if len(level) > 1 << k else level[:0]
    return out


def _local(pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs in a range of rows, in order of character and place. gap and gap_at: the least lcp, and the last row that has it, between a run and the one of
    its character before, or the range's begin (head); rest and rest_at: the same behind the last one (tail); whole and whole_at: of the range."""
    pdf = pdf.sort_values("sa_rank")
    rows, m = pdf["sa_rank"].to_numpy(np.int64), len(pdf)
    key = (pdf["lcp"].to_numpy(np.int64) << _BITS) | np.arange(m - 1, -1, -1, dtype=np.int64)
    codes, letters = pd.factorize(pdf["bwt"])
    begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    end = np.r_[begin[1:], m] - 1
    order = np.argsort(codes[begin], kind="stable")
    begin, end = begin[order], end[order]
    ch = codes[begin]
    head, tail = np.r_[True, ch[1:] != ch[:-1]], np.r_[ch[1:] != ch[:-1], True]
    gap = _least(key, np.where(head, 0, np.r_[0, end[:-1] + 1]), begin)
    behind = tail & (end < m - 1)
    rest = _least(key, end[behind] + 1, np.full(int(behind.sum()), m - 1))
    low = lambda k: k >> _BITS
    at = lambda k: rows[m - 1 - (k & ((1 << _BITS) - 1))]
    place = [dict(zip(_POSITION, map(int, x), strict=True)) for x in zip(*(pdf[c].to_numpy(np.int64) for c in _POSITION), strict=True)]
    out = pd.DataFrame({"part": int(pdf["part"].iloc[0]), "ch": np.asarray(letters)[ch], "first_row": rows[begin], "last_row": rows[end]})
    out["top"], out["bottom"] = [place[b] for b in begin], [place[e] for e in end]
    out["head"], out["tail"], out["gap"], out["gap_at"] = head, tail, low(gap), at(gap)
    for name, values in (("rest", low(rest)), ("rest_at", at(rest))):
        full = np.full(len(out), None, object)
        full[behind] = values
        out[name] = full
    least = _least(key, np.array([0]), np.array([m - 1]))
    out["whole"], out["whole_at"] = int(low(least)[0]), int(at(least)[0])
    return out


def choices(table: DataFrame, mode: str, n: int) -> tuple[DataFrame, DataFrame, int]:
    """(place, first_row, last_row, top, bottom) of the runs, (c, code) of the alphabet, and the number of places.

    The rows for which the walk takes a run of a character begin at its threshold: where the lcps between it and the run before are least, the last such row. place is
    that row, after n rows for each smaller character. Runs are cut where ranges of rows are; each range is gone through once, and
    what lies between two runs of a character in different ranges comes from a row per range.
    """
    size = range_size(n)
    rows = table.select(F.floor(F.col("sa_rank") / size).alias("part"), "sa_rank", "bwt", "lcp", *_POSITION)
    local = stored(rows.groupBy("part").applyInPandas(_local, _LOCAL), "local")
    least = lambda low, at: F.when(F.col(low).isNotNull(), F.struct(F.col(low).alias("low"), (-F.col(at)).alias("at")))  # noqa: E731  the last one of the least
    whole = local.groupBy(F.col("part").alias("between")).agg(F.first(least("whole", "whole_at")).alias("whole"))
    ends = local.groupBy("ch", "part").agg(F.first(F.when(F.col("head"), least("gap", "gap_at")), ignorenulls=True).alias("own"), F.first(F.when(F.col("tail"), least("rest", "rest_at")), ignorenulls=True).alias("rest"))
    before = Window.partitionBy("ch").orderBy("part")  # a row per range
    ends = ends.withColumn("before", F.lag("part").over(before)).withColumn("rest", F.lag("rest").over(before))
    apart = ends.where("before < part - 1").select("ch", "part", F.explode(F.sequence(F.col("before") + 1, F.col("part") - 1)).alias("between"))
    apart = apart.join(whole, "between").groupBy("ch", "part").agg(F.min("whole").alias("whole"))
    ends = ends.join(apart, ["ch", "part"], "left").select("ch", "part", F.coalesce(F.when(F.col("before").isNotNull(), -F.array_min(F.array_compact(F.array("own", "rest", "whole")))["at"]), F.lit(0)).alias("entry"))
    codes = local.where("ch <> '$'").select("ch").distinct().select("ch", (F.row_number().over(Window.orderBy(by_letter(F.col("ch"), mode))) - 1).cast("long").alias("code"))  # the alphabet
    codes = stored(codes, "alphabet")
    found = local.join(ends, ["ch", "part"]).join(codes, "ch")
    place = F.col("code") * n + F.when(F.col("head"), F.col("entry")).otherwise(F.col("gap_at"))
    found = stored(found.select(place.alias("place"), "first_row", "last_row", "top", "bottom"), "choices")
    return found, codes.select(F.col("ch").alias("c"), "code"), codes.count() * n


def _agreeing(steps: DataFrame, parts: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """steps(k, i, stop, text_pos, seq_id, off) with same: how many characters ahead of off the sequence shares with the pattern ahead of i, i - stop at most.

    parts are the pieces of the sequences, texts those of the patterns, each with the next one. Each piece is compared on its own, most characters in
    all; the first difference counts.
    """
    width = F.least(F.col("i") - F.col("stop"), F.col("off"), F.lit(most).cast("long"))
    rows = steps.withColumn("width", width)
    first = F.floor((F.col("off") - F.col("width")) / PIECE) * PIECE
    rows = rows.withColumn("at", F.explode_outer(F.when(F.col("width") > 0, F.sequence(first, F.col("off") - 1, F.lit(PIECE).cast("long")))))
    rows = rows.withColumn("begin", F.greatest(F.col("at"), F.col("off") - F.col("width"))).withColumn("end", F.least(F.col("at") + PIECE, F.col("off")))
    rows = rows.withColumn("from", F.col("i") - F.col("off") + F.col("begin")).withColumn("in", F.floor(F.col("from") / PIECE) * PIECE)
    rows = rows.join(parts.select("seq_id", F.col("off").alias("at"), "piece"), ["seq_id", "at"], "left")
    rows = rows.join(texts.select("k", F.col("off").alias("in"), "text"), ["k", "in"], "left")
    size = F.col("end") - F.col("begin")
    part = lambda c, at: F.reverse(F.substring(c, (at + 1).cast("int"), size.cast("int")))
    shared = common_prefix(part("piece", F.col("begin") - F.col("at")), part("text", F.col("from") - F.col("in")), PIECE)
    rows = rows.withColumn("shared", shared).withColumn("differs", F.when(F.col("shared") < size, F.col("off") - F.col("end") + F.col("shared")))
    return rows.groupBy(*steps.columns, "width").agg(F.min("differs").alias("differs")).select(*steps.columns, F.coalesce("differs", "width").alias("same"))


def walked(table: DataFrame, sequences: DataFrame, patterns: DataFrame, on_bad: str = "error", mode: str = "dna") -> DataFrame:
    """(name, i, len, pos) of each place of each pattern(name, seq): the same as matching.matching_statistics() by the reference rule, for an index of any size."""
    n = table.count()
    names = stored(numbered(patterns), "patterns")
    runs, codes, size = choices(table, mode, n)
    # an endmarker is no character to the walk, nor is one that sorts like another: both become one that the collection lacks
    known = {r[0] for r in codes.select("c").collect()}
    lacking = next(c for c in map(chr, count(0xE000)) if c not in known)
    odd = "".join(c for c in ("$Z" if mode == "dna" else "$") if c not in known)
    asked = names.select("k", F.translate("seq", odd, lacking * len(odd)).alias("seq"))
    _, found = lengths_by_order(sequences, asked, mode)
    before = sequences.count()
    found = found.join(names.select((F.col("k") + before).alias("seq_id"), "k", F.length("seq").alias("size")), "seq_id").where(F.col("off") < F.col("size"))
    lens = stored(found.select("k", F.col("off").alias("i"), F.col("l").alias("len"), "row"), "lengths")
    if on_bad == "error" and (bad := lens.where("len = 0").join(names, "k").select(F.substring("seq", (F.col("i") + 1).cast("int"), F.lit(1))).first()):
        raise ValueError(f"{bad[0]!r} does not occur in the collection")
    parts = stored(pieces(sequences, PIECE), "pieces")
    own = stored(pieces(asked.select(F.col("k").alias("seq_id"), "seq"), PIECE).select(F.col("seq_id").alias("k"), "off", "piece"), "pieces")
    after = own.select("k", (F.col("off") - PIECE).alias("off"), F.col("piece").alias("next"))
    texts = stored(own.join(after, ["k", "off"], "left").select("k", "off", F.concat("piece", F.coalesce("next", F.lit(""))).alias("text")), "texts")
    # places whose matches end at the same one are steps of one match, which begins where it was cut to, or anew in the last row
    matches = lens.where("len > 0").groupBy("k", (F.col("i") + F.col("len")).alias("end")).agg(F.min("i").alias("stop"), F.max("i").alias("i"))
    cut = lens.select("k", (F.col("i") - 1).alias("i"), "row")
    rows = matches.join(cut, ["k", "i"], "left").select("k", "i", "stop", F.coalesce("row", F.lit(n - 1).cast("long")).alias("row"))
    at_rows = table.select(F.col("sa_rank").alias("row"), *_POSITION)
    rows = stored(rows.join(at_rows, "row"), "begins")
    steps, most = [], PIECE
    while not rows.isEmpty():
        chars = rows.withColumn("in", F.floor(F.col("i") / PIECE) * PIECE).join(texts.withColumnRenamed("off", "in"), ["k", "in"])
        chars = chars.withColumn("c", F.substring("text", (F.col("i") - F.col("in") + 1).cast("int"), F.lit(1))).drop("in", "text")
        chars = chars.join(codes, "c").withColumn("at", F.col("code") * n + F.col("row")).drop("c", "code")
        taken = as_of(chars, "at", runs, "place", ("first_row", "last_row", "top", "bottom"), size)
        to = F.when(F.col("row") < F.col("first_row"), F.col("top")).when(F.col("row") > F.col("last_row"), F.col("bottom")).otherwise(F.struct(*_POSITION))
        taken = taken.withColumn("to", to).select("k", "i", "stop", (F.col("to.text_pos") - 1).alias("text_pos"), "to.seq_id", (F.col("to.off") - 1).alias("off"))
        steps.append(stored(_agreeing(taken, parts, texts, most), "steps"))
        most *= 2
        left = steps[-1].where("i - same > stop").select("k", (F.col("i") - F.col("same") - 1).alias("i"), "stop", (F.col("text_pos") - F.col("same")).alias("text_pos"), "seq_id", (F.col("off") - F.col("same")).alias("off"))
        rows = stored(left.join(at_rows.select("row", "text_pos"), "text_pos"), "begins")
    spark = table.sparkSession
    schema = "k long, i long, stop long, text_pos long, seq_id long, off long, same long"
    made = spark.read.schema(schema).parquet(*(f for s in steps for f in s.inputFiles())) if steps else spark.createDataFrame([], schema)
    made = made.select("k", "i", "text_pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same"))).alias("j"))
    made = made.select("k", (F.col("i") - F.col("j")).alias("i"), (F.col("text_pos") - F.col("j")).alias("pos"))
    return lens.join(made, ["k", "i"], "left").join(names.select("k", "name"), "k").select("name", "i", "len", "pos")
