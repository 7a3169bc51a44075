"""Suffix order of a collection, and what follows from it row by row.

suffixes(seq_id, off, text_pos, sa_rank, bwt, lcp, run_id): a row per position, the endmarker's (off = len) included.
Suffixes sort by their characters up to the end of their sequence, then by seq_id: endmarkers are distinct and
ordered by sequence. bwt is the character before, "$" at a start; lcp is the common prefix with the suffix above.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.strings import characters, common_prefix, order_key
from helixmill.plans.tables import ranked, running, stored
from helixmill.sources.sequences import starts

#: Characters of all suffixes together up to which they are sorted as strings.
AS_STRINGS = 1 << 30
#: Characters of a piece in which sequences are taken apart.
PIECE = 1 << 12


def pieces(sequences: DataFrame, size: int = PIECE) -> DataFrame:
    """(seq_id, off, piece, before, last): sequences cut into pieces of size characters, in one pass over each, and dealt to all tasks.

    before is the character ahead of a piece, "$" at a start; last says that no piece follows. An empty sequence has one empty piece.
    """
    cut = F.regexp_extract_all(F.col("seq"), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = sequences.select("seq_id", F.when(F.col("seq") == "", F.array(F.lit(""))).otherwise(cut).alias("cut"))
    own = F.transform("cut", lambda x, i: F.struct(x.alias("piece"), F.when(i == 0, F.lit("$")).otherwise(F.substring(F.get("cut", i - 1), -1, 1)).alias("before"), (i == F.size("cut") - 1).alias("last")))
    rows = rows.select("seq_id", F.posexplode(own).alias("k", "p")).select("seq_id", (F.col("k").cast("long") * size).alias("off"), "p.*")
    return rows.repartition("seq_id", "off")


def positions(sequences: DataFrame) -> DataFrame:
    """(seq_id, off, text_pos, c, bwt), a row per text position: its character ("" for an endmarker) and the one before."""
    rows = pieces(sequences).join(starts(sequences), "seq_id")
    rows = rows.select("seq_id", "off", "start", "before", F.concat(characters(F.col("piece")), F.when(F.col("last"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))).alias("chars"))
    own = F.transform("chars", lambda c, i: F.struct(i.cast("long").alias("i"), c.alias("c"), F.when(i == 0, F.col("before")).otherwise(F.get("chars", i - 1)).alias("bwt")))
    rows = rows.select("seq_id", "off", "start", F.explode(own).alias("p"))
    return rows.select("seq_id", (F.col("off") + F.col("p.i")).alias("off"), (F.col("start") + F.col("off") + F.col("p.i")).alias("text_pos"), "p.c", "p.bwt")


_KEYS: dict[str, Callable[[Column], Column]] = {"dna": order_key, "text": lambda c: c}


def suffixes(sequences: DataFrame, method: str = "auto", mode: str = "dna") -> DataFrame:
    """The suffix table. mode "dna" puts N behind T, "text" sorts by code points. method "strings" sorts suffixes as strings,
    "doubling" never makes one; "auto" goes by their total length. Both give the same rows."""
    if method == "auto":
        total = sequences.agg(F.sum(F.col("len") * F.col("len") / 2)).first()[0] or 0
        method = "strings" if total <= AS_STRINGS else "doubling"
    if method == "doubling":
        return suffixes_of(positions(sequences), mode)
    if method != "strings":
        raise ValueError(f"method: {method}")
    longest = sequences.agg(F.max("len")).first()[0] or 0
    rows = sequences.select("seq_id", "seq", "len").join(starts(sequences), "seq_id")
    rows = rows.select("seq_id", "seq", "len", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len"))).alias("off"))
    before = F.when(F.col("off") == 0, F.lit("$")).otherwise(F.substring("seq", F.col("off").cast("int"), F.lit(1)))
    rows = rows.select("seq_id", "off", (F.col("start") + F.col("off")).alias("text_pos"), before.alias("bwt"), F.substring("seq", (F.col("off") + 1).cast("int"), F.col("len").cast("int")).alias("suf"))
    rows = ranked(rows, "sa_rank", _KEYS[mode](F.col("suf")), F.col("seq_id"))
    above = rows.select((F.col("sa_rank") + 1).alias("sa_rank"), F.col("suf").alias("above"), F.col("bwt").alias("above_bwt"))
    rows = rows.join(above, "sa_rank", "left").withColumn("lcp", F.coalesce(common_prefix(F.col("suf"), F.col("above"), longest), F.lit(0).cast("long")))
    return _with_runs(rows)


def suffixes_of(rows: DataFrame, mode: str = "dna") -> DataFrame:
    """The suffix table from positions(), wherever they come from: ranks by prefix doubling, and no suffix as a string."""
    return _with_runs(_doubled(rows, _KEYS[mode]))


def _with_runs(rows: DataFrame) -> DataFrame:
    head = F.when((F.col("bwt") == "$") | F.col("above_bwt").isNull() | (F.col("above_bwt") != F.col("bwt")), 1).otherwise(0)
    rows = stored(rows.select("seq_id", "off", "text_pos", "sa_rank", "bwt", "lcp", head.alias("head")), "suffixes")
    rows = running(rows, "sa_rank", "head", "run_id").withColumn("run_id", F.col("run_id") - 1)
    return stored(rows.select("seq_id", "off", "text_pos", "sa_rank", "bwt", "lcp", "run_id"), "suffixes")


def _doubled(rows: DataFrame, order: Callable[[Column], Column]) -> DataFrame:
    """Ranks by prefix doubling, and LCPs by descending powers of two over its rank tables; one position is one small row.

    A table says for each text position which rank its first h characters have; endmarkers are characters of their own, so
    no prefix of two positions is equal beyond a sequence's end.
    """
    end = F.col("c") == ""
    key = F.when(end, F.struct(F.lit("").alias("c"), F.col("seq_id").alias("s"))).otherwise(F.struct(order(F.col("c")).alias("c"), F.lit(0).cast("long").alias("s")))
    base = stored(rows.select("seq_id", "off", "text_pos", "bwt", key.alias("key")), "positions")

    def numbered(keyed: DataFrame) -> tuple[DataFrame, bool]:
        groups = ranked(keyed.groupBy("key").agg(F.count("*").alias("n")), "g", F.col("key"))
        groups = running(groups, "g", "n", "upto")
        distinct = groups.agg(F.max("n")).first()[0] in (None, 1)
        return stored(keyed.join(groups.select("key", (F.col("upto") - F.col("n")).alias("r")), "key").select("text_pos", "r"), "ranks"), distinct

    tables, h = [], 1
    table, distinct = numbered(base.select("text_pos", "key"))
    tables.append(table)
    while not distinct:
        later = table.select((F.col("text_pos") - h).alias("text_pos"), F.col("r").alias("r2"))
        keyed = table.join(later, "text_pos", "left").select("text_pos", F.struct("r", F.coalesce("r2", F.lit(-1)).alias("r2")).alias("key"))
        table, distinct = numbered(keyed)
        h *= 2
        tables.append(table)
    out = base.join(table.withColumnRenamed("r", "sa_rank"), "text_pos").select("seq_id", "off", "text_pos", "bwt", "sa_rank")
    above = out.select((F.col("sa_rank") + 1).alias("sa_rank"), F.col("text_pos").alias("above_pos"), F.col("bwt").alias("above_bwt"))
    out = out.join(above, "sa_rank", "left").withColumn("lcp", F.lit(0).cast("long"))
    # the last table tells all positions apart, so common prefixes are shorter than its h
    for i in reversed(range(len(tables) - 1)):
        own = tables[i].select((F.col("text_pos")).alias("p1"), F.col("r").alias("r1"))
        other = tables[i].select((F.col("text_pos")).alias("p2"), F.col("r").alias("r2"))
        out = out.join(own, F.col("text_pos") + F.col("lcp") == F.col("p1"), "left").join(other, F.col("above_pos") + F.col("lcp") == F.col("p2"), "left")
        out = stored(out.withColumn("lcp", F.col("lcp") + F.when(F.col("r1") == F.col("r2"), 1 << i).otherwise(0)).drop("p1", "p2", "r1", "r2"), "lcp")
    return out.drop("above_pos")


def neighbours(table: DataFrame) -> DataFrame:
    """(text_pos, sa_rank, lf, psi, phi, inv_phi) of every row: the ranks of the positions before and after, and the
    positions of the suffixes above and below. All four are permutations that wrap around."""
    n = table.count()
    rows = table.select("text_pos", "sa_rank")
    at = lambda name, pos: rows.select(F.pmod(F.col("text_pos") + pos, F.lit(n)).alias("text_pos"), F.col("sa_rank").alias(name))
    near = lambda name, d: rows.select(F.pmod(F.col("sa_rank") + d, F.lit(n)).alias("sa_rank"), F.col("text_pos").alias(name))
    out = rows.join(at("lf", 1), "text_pos").join(at("psi", -1), "text_pos")
    return out.join(near("phi", 1), "sa_rank").join(near("inv_phi", -1), "sa_rank").select("text_pos", "sa_rank", "lf", "psi", "phi", "inv_phi")
