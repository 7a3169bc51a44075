"""Repeats within a collection: supermaximal repeats and maximal repeat pairs.

Both come from ranks, positions and LCPs of a suffix table alone: suffixes that share a prefix are neighbours, and
two share the least LCP between them. Where all suffixes with a prefix are wanted, ranks are cut into blocks: most ranges end in
their block, and the others are followed over a row per block.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.plans.tables import as_of, running, stored

#: Rows of a block.
BLOCK = 1 << 16


def _at_least(least: int) -> None:
    if least < 1:
        raise ValueError("the least length must be 1 or more")


def minima(table: DataFrame, least: int) -> list[DataFrame]:
    """The k-th is (at, low): the least lcp of the 2^k rows from rank at on, where it is least or more; the last is empty."""
    levels = [stored(table.where(F.col("lcp") >= least).select(F.col("sa_rank").alias("at"), F.col("lcp").alias("low")), "minima")]
    while not levels[-1].isEmpty():
        half = levels[-1]
        later = half.select((F.col("at") - (1 << (len(levels) - 1))).alias("at"), F.col("low").alias("low2"))
        levels.append(stored(half.join(later, "at").select("at", F.least("low", "low2").alias("low")), "minima"))
    return levels


def widened(rows: DataFrame, levels: list[DataFrame], length: str) -> DataFrame:
    """rows(lo, hi, ...) with the range of ranks grown as far as all LCPs inside are length or more, by halving steps."""
    names = [c for c in rows.columns if c not in ("lo", "hi")]
    for k in reversed(range(len(levels) - 1)):
        step = 1 << k
        up = levels[k].select((F.col("at") + step - 1).alias("lo"), F.col("low").alias("up"))
        down = levels[k].select((F.col("at") - 1).alias("hi"), F.col("low").alias("down"))
        grown = lambda low: F.when(F.col(low) >= F.col(length), step).otherwise(0)  # noqa: B023, E731
        rows = rows.join(up, "lo", "left").join(down, "hi", "left")
        rows = stored(rows.select(*names, (F.col("lo") - grown("up")).alias("lo"), (F.col("hi") + grown("down")).alias("hi")), "ranges")
    return rows


def _ends(part: pd.DataFrame) -> pd.DataFrame:
    """Of a block of rows (b, sa_rank, lcp, l): for each row with an l, the first and last rank of the neighbours that share l characters with
    it, -1 where they go on beyond the block; and the places of lcps that are less than all behind ("last") or before them ("first")."""
    part = part.sort_values("sa_rank")
    rank, lcp = part["sa_rank"].tolist(), part["lcp"].tolist()
    wanted = [None if pd.isna(x) else int(x) for x in part["l"]]
    lo, hi = [-1] * len(rank), [-1] * len(rank)
    low: list[int] = []  # lcps of the stack, in ascending order
    at: list[int] = []

    def push(i: int) -> None:
        while low and low[-1] >= lcp[i]:
            low.pop()
            at.pop()
        low.append(lcp[i])
        at.append(rank[i])

    for i in range(len(rank)):
        push(i)
        if wanted[i] is not None and (k := bisect_left(low, wanted[i])):
            lo[i] = at[k - 1]
    out = [("last", r, v, None, None, None) for r, v in zip(at, low, strict=True)]
    low.clear()
    at.clear()
    for i in reversed(range(len(rank))):
        if wanted[i] is not None and (k := bisect_left(low, wanted[i])):
            hi[i] = at[k - 1] - 1
        push(i)
    out += [("first", r, v, None, None, None) for r, v in zip(at, low, strict=True)]
    out += [("range", r, None, x, a, b) for r, x, a, b in zip(rank, wanted, lo, hi, strict=True) if x is not None]
    found = pd.DataFrame(out, columns=["kind", "sa_rank", "lcp", "l", "lo", "hi"]).astype(dict.fromkeys(("lcp", "l", "lo", "hi"), "Int64"))
    return found.assign(b=part["b"].iloc[0])


def extents(table: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows(sa_rank, l, ...) with lo and hi, the ranks of the first and the last suffix that share l characters (1 or more) with that of sa_rank.

    A block is worked on alone. What goes on beyond it is followed over least LCPs of blocks, and ends at one of the few places of
    another block where its LCPs fall, which an as-of join finds. So the table is shuffled once, whatever the lengths of the ranges.
    """
    n, longest = table.agg(F.count("*"), F.max("lcp")).first()
    given = table.select("sa_rank", "lcp").join(rows.select("sa_rank", "l"), "sa_rank", "left").withColumn("b", F.floor(F.col("sa_rank") / block))
    found = stored(given.groupBy("b").applyInPandas(_ends, "kind string, sa_rank long, lcp long, l long, lo long, hi long, b long"), "extents")
    ranges = found.where("kind = 'range'").select("sa_rank", "l", "lo", "hi", "b")
    left_open = ranges.where("lo < 0 or hi < 0").select("b", "l").distinct().select("b", "l", (F.col("b") - 1).alias("lo"), F.col("b").alias("hi"))
    blocks = found.where("kind = 'last'").groupBy("b").agg(F.min("lcp").alias("lcp")).withColumnRenamed("b", "sa_rank")
    ends = widened(stored(left_open, "open"), minima(blocks, 1), "l")  # lo: the block before with less than l; hi: the last one without
    width = (longest or 0) + 1
    size = (-(-(n or 0) // block) + 1) * width

    def falls(kind: str, at: str, to: str) -> DataFrame:
        places = found.where(F.col("kind") == kind).select((F.col("b") * width + F.col("lcp")).alias("place"), F.col("sa_rank").alias(to), F.col("b").alias("of"))
        asked = ends.where(F.col(at) >= 0).select("b", "l", at, (F.col(at) * width + F.least(F.col("l"), F.lit(width)) - 1).alias("asked"))
        return as_of(asked, "asked", places, "place", (to, "of"), size).where(F.col("of") == F.col(at)).select(F.col("b").alias("own"), F.col("l").alias("own_l"), to)

    ends = ends.withColumn("hi", F.col("hi") + 1)
    out = ranges.withColumnsRenamed({"lo": "lo_in", "hi": "hi_in"})
    for kind, at, to in (("last", "lo", "begin"), ("first", "hi", "stop")):
        ends_at = falls(kind, at, to)
        out = out.join(ends_at, (F.col("b") == F.col("own")) & (F.col("l") == F.col("own_l")), "left").drop("own", "own_l")
    out = out.select("sa_rank", F.when(F.col("lo_in") >= 0, F.col("lo_in")).otherwise(F.col("begin")).alias("lo"), F.when(F.col("hi_in") >= 0, F.col("hi_in")).otherwise(F.coalesce(F.col("stop") - 1, F.lit(n - 1 if n else 0))).alias("hi"))
    return rows.join(out, "sa_rank")


def _supermaximal(table: DataFrame, least: int) -> DataFrame:
    """(seq_id, off, sa_rank, l, lo, hi): the places, and the ranks of all suffixes with the prefix."""
    _at_least(least)
    below = table.select((F.col("sa_rank") - 1).alias("sa_rank"), F.col("lcp").alias("below"))
    longest = table.join(below, "sa_rank", "left").withColumn("l", F.greatest("lcp", F.coalesce("below", F.lit(0))))
    before = longest.select((F.col("text_pos") + 1).alias("text_pos"), F.col("l").alias("l_before"))
    found = longest.join(before, "text_pos", "left").where((F.col("l") >= least) & ((F.col("off") == 0) | (F.col("l_before") <= F.col("l"))))
    return extents(table, stored(found.select("seq_id", "off", "sa_rank", "l"), "found"), BLOCK)


def supermaximal_repeats(table: DataFrame, least: int = 1, others: bool = True) -> DataFrame:
    """(seq, pos, len, occ, others): positions whose longest repeated prefix is at least so long and can't be extended to the left.

    len is the larger lcp with the suffixes above and below; the position before (in the same sequence) has none larger.
    occ counts the suffixes that share the prefix, and others lists the other ones in suffix order. Without others, that column is
    left out, and a row is small however often its repeat occurs; occurrences() gives a row for each.
    """
    found = _supermaximal(table, least)
    names = [F.col("seq_id").alias("seq"), F.col("off").alias("pos"), F.col("l").alias("len"), (F.col("hi") - F.col("lo") + 1).alias("occ")]
    if not others:
        return found.select(*names)
    hits = found.select("lo", "hi").distinct().select("lo", "hi", F.explode(F.sequence("lo", "hi")).alias("r"))
    hits = hits.join(table.select(F.col("sa_rank").alias("r"), F.col("seq_id").alias("seq"), F.col("off").alias("pos")), "r")
    groups = hits.groupBy("lo", "hi").agg(F.sort_array(F.collect_list(F.struct("r", "seq", "pos"))).alias("all"))
    listed = F.transform(F.filter("all", lambda o: o["r"] != F.col("sa_rank")), lambda o: F.struct(o["seq"].alias("seq"), o["pos"].alias("pos")))
    return found.join(groups, ["lo", "hi"]).select(*names, listed.alias("others"))


def occurrences(table: DataFrame, least: int = 1) -> DataFrame:
    """(seq, pos, len, k, other_seq, other_pos): a row per supermaximal repeat and other occurrence, k from 0 in suffix order; nothing is collected."""
    found = _supermaximal(table, least).select("seq_id", "off", "l", "sa_rank", F.posexplode(F.filter(F.sequence("lo", "hi"), lambda r: r != F.col("sa_rank"))).alias("k", "r"))
    other = table.select(F.col("sa_rank").alias("r"), F.col("seq_id").alias("other_seq"), F.col("off").alias("other_pos"))
    return found.join(other, "r").select(F.col("seq_id").alias("seq"), F.col("off").alias("pos"), F.col("l").alias("len"), F.col("k").cast("long").alias("k"), "other_seq", "other_pos")


def extensions(levels: list[DataFrame], pairs: DataFrame) -> DataFrame:
    """pairs(first, last, ...) with len, the common prefix of the suffixes of ranks first < last: the least lcp of rows first + 1 to last. Pairs
    with less than the least of the levels are left out."""
    names = pairs.columns
    # the largest power of two of rows that fits, once from the first row and once up to the last
    pairs = pairs.withColumn("k", (F.length(F.bin(F.col("last") - F.col("first"))) - 1).cast("int")).withColumn("from", F.col("first") + 1)
    ranges = levels[-1].withColumn("k", F.lit(len(levels) - 1))
    for k, level in enumerate(levels[:-1]):
        ranges = ranges.unionByName(level.withColumn("k", F.lit(k)))
    own = ranges.select("k", F.col("at").alias("from"), F.col("low").alias("low1"))
    other = ranges.select("k", F.expr("at + shiftleft(1L, k) - 1").alias("last"), F.col("low").alias("low2"))
    return pairs.join(own, ["k", "from"]).join(other, ["k", "last"]).select(*names, F.least("low1", "low2").alias("len"))


def maximal_repeats(table: DataFrame, least: int, most_pairs: int | None = None) -> DataFrame:
    """(seq1, pos1, seq2, pos2, len): pairs of positions that share at least so many characters and have different ones before.

    Each pair comes once, the smaller text position first; two sequence starts always differ. Suffixes with the same first characters
    are a run of neighbours with LCPs of least or more; pairs are made in each run. The result is quadratic in the copies of a
    repeat: with most_pairs, it raises if the runs would make more.
    """
    _at_least(least)
    heads = table.select("seq_id", "off", "text_pos", "bwt", "sa_rank", F.when(F.col("lcp") < least, 1).otherwise(0).alias("head"))
    seeds = stored(running(heads, "sa_rank", "head", "seed").drop("head"), "seeds")
    if most_pairs is not None:
        n = seeds.groupBy("seed").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
        if n > most_pairs:
            raise ValueError(f"{n:.0f} pairs share {least} characters; at most {most_pairs} are allowed: ask for longer repeats")
    x, y = seeds.alias("x"), seeds.alias("y")
    pairs = x.join(y, (F.col("x.seed") == F.col("y.seed")) & (F.col("x.text_pos") < F.col("y.text_pos")) & ((F.col("x.bwt") == "$") | (F.col("x.bwt") != F.col("y.bwt"))))
    pairs = pairs.select(F.col("x.seq_id").alias("seq1"), F.col("x.off").alias("pos1"), F.col("y.seq_id").alias("seq2"), F.col("y.off").alias("pos2"), F.least("x.sa_rank", "y.sa_rank").alias("first"), F.greatest("x.sa_rank", "y.sa_rank").alias("last"))
    return extensions(minima(table, least), pairs).select("seq1", "pos1", "seq2", "pos2", "len")
