"""Checks of an index, and views of what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.strings import bit_width
from helixmill.operators.inverse import ends_of
from helixmill.operators.maps import expanded
from helixmill.operators.runs import rlbwt
from helixmill.operators.suffixes import neighbours
from helixmill.plans.tables import stored

#: Checks, in the order in which they are listed.
CHECKS = ("lf", "psi", "phi", "inv_phi", "text_by_lf", "text_by_psi")
#: Rows up to which cycles are found by pointer doubling; larger ones are contracted first.
SMALL = 1 << 16


def _joined(chars: DataFrame) -> DataFrame:
    """(seq_id, seq) from (seq_id, at, c); a sequence is one cell."""
    rows = chars.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("at", "c"))).alias("c"))
    return rows.select("seq_id", F.array_join(F.transform("c", lambda x: x["c"]), "").alias("seq"))


def recovered(table: DataFrame, by: str = "lf", near: DataFrame | None = None) -> DataFrame:
    """(seq_id, seq) put together again by walking LF or Psi over the rows of the BWT, from their characters alone; near: neighbours(table).

    LF leads from every row to the start of its sequence, Psi to its endmarker, whose row is the number of the sequence.
    """
    near = neighbours(table) if near is None else near
    rows = stored(near.select("sa_rank", "lf", "psi").join(table.select("sa_rank", "bwt"), "sa_rank").select("sa_rank", "bwt", "lf", "psi"), "walk")
    ends = rows.where("bwt = '$'").count()
    if by == "lf":
        found = ends_of(rows.where("bwt <> '$'").select(F.col("sa_rank").alias("x"), F.col("lf").alias("y")), rows.where("bwt = '$'").select(F.col("sa_rank").alias("x")))
        starts = rows.where("bwt = '$'").select(F.col("sa_rank").alias("end"), F.pmod(F.col("lf") + 1, F.lit(max(ends, 1))).alias("seq_id"))
        found = found.join(starts, "end").withColumn("at", F.col("dist"))
    else:
        found = ends_of(rows.where(F.col("sa_rank") >= ends).select(F.col("sa_rank").alias("x"), F.col("psi").alias("y")), rows.where(F.col("sa_rank") < ends).select(F.col("sa_rank").alias("x")))
        found = found.withColumn("seq_id", F.col("end")).withColumn("at", -F.col("dist"))
    chars = found.join(rows.where("bwt <> '$'").select(F.col("sa_rank").alias("x"), F.col("bwt").alias("c")), "x").select("seq_id", "at", "c")
    empty = rows.where("bwt = '$'").select(F.pmod(F.col("lf") + 1, F.lit(max(ends, 1))).alias("seq_id"))
    return empty.join(_joined(chars), "seq_id", "left").select("seq_id", F.coalesce("seq", F.lit("")).alias("seq"))


def cycles(steps: DataFrame, small: int = SMALL) -> DataFrame:
    """(name, cycles) of each one-to-one map (name, x, y).

    While there are many rows, a random part of them without neighbours is taken out in every round, and their
    steps become part of those before; so all rounds together read a few times the table. The rest is done by pointer doubling.
    """
    whole = stored(steps.select("name", "x", "y"), "cycles")
    loops, r, n = whole.where("x = y").groupBy("name").count(), 0, whole.count()
    table = whole.where("x <> y")
    found = [loops]
    while n > small and r < 200:
        coin = lambda c: F.pmod(F.xxhash64("name", c, F.lit(r)), F.lit(2))  # noqa: B023, E731
        marked = table.withColumn("a", coin("x")).withColumn("b", coin("y"))
        gone = marked.where("a = 0 and b = 1").select("name", F.col("y").alias("g"))
        later = marked.where("a = 1").select(F.col("name").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        stay = marked.where("a = 0 and b = 1").join(later, (F.col("name") == F.col("n2")) & (F.col("y") == F.col("x2"))).select("name", "x", F.col("y2").alias("y"))
        kept = marked.where("not (a = 0 and b = 1)").join(gone, (marked["name"] == gone["name"]) & (F.col("x") == F.col("g")), "left_anti").select("name", "x", "y")
        table = stored(stay.unionByName(kept), "cycles")
        found.append(stored(table.where("x = y").groupBy("name").count(), "loops"))
        table = table.where("x <> y")
        n, r = table.count(), r + 1
    rest = table.withColumn("least", F.least("x", "y"))
    for _ in range(max(1, n.bit_length())):
        later = rest.select(F.col("name").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("least").alias("l2"))
        rest = stored(rest.join(later, (F.col("name") == F.col("n2")) & (F.col("y") == F.col("x2"))).select("name", "x", F.col("y2").alias("y"), F.least("least", "l2").alias("least")), "cycles")
    total = rest.groupBy("name").agg(F.countDistinct("least").alias("count"))
    for part in found:
        total = total.unionByName(part)
    return total.groupBy("name").agg(F.sum("count").alias("cycles"))


def verify(table: DataFrame, sequences: DataFrame, checks: tuple[str, ...] = CHECKS, intervals: dict[str, DataFrame] | None = None) -> DataFrame:
    """(check, ok, detail): LF, Psi, Phi and inverse Phi are permutations of a single cycle, and walks of LF and of Psi give the texts.

    intervals: the interval maps of an index by name, which are then what is checked; without them, the maps that follow from the table.
    """
    if unknown := set(checks) - set(CHECKS):
        raise ValueError(f"checks: {unknown}")
    places = {"lf": "sa_rank", "psi": "sa_rank", "phi": "text_pos", "inv_phi": "text_pos"}
    if intervals is None:
        near = stored(neighbours(table), "neighbours")
        steps = {k: near.select(F.col(x).alias("x"), F.col(k).alias("y")) for k, x in places.items()}
    else:
        steps = {k: expanded(m).select(F.col("position").alias("x"), F.col("dest").alias("y")) for k, m in intervals.items()}
        near = steps["lf"].select(F.col("x").alias("sa_rank"), F.col("y").alias("lf")).join(steps["psi"].select(F.col("x").alias("sa_rank"), F.col("y").alias("psi")), "sa_rank")
    out, maps = None, None
    for k in (k for k in places if k in checks):
        own = steps[k].select(F.lit(k).alias("name"), "x", "y")
        maps = own if maps is None else maps.unionByName(own)
    if maps is not None:
        maps = stored(maps, "maps")
        bijective = maps.groupBy("name").agg(F.countDistinct("y").alias("images"), F.count("*").alias("n"))
        out = bijective.join(cycles(maps), "name").select(F.col("name").alias("check"), ((F.col("images") == F.col("n")) & (F.col("cycles") == 1)).alias("ok"), F.concat_ws(" ", F.lit("cycles:"), "cycles").alias("detail"))
    for by in ("lf", "psi"):
        if f"text_by_{by}" in checks:
            both = recovered(table, by, near).select("seq_id", F.col("seq").alias("again")).join(sequences, "seq_id", "full")
            text = both.agg(F.count_if(~F.col("seq").eqNullSafe(F.col("again"))).alias("bad"))
            text = text.select(F.lit(f"text_by_{by}").alias("check"), (F.col("bad") == 0).alias("ok"), F.concat_ws(" ", F.lit("sequences that differ:"), "bad").alias("detail"))
            out = text if out is None else out.unionByName(text)
    return out


def statistics(table: DataFrame) -> DataFrame:
    """(n, sequences, runs, runs_of_letters, longest_run, longest_lcp): one row."""
    runs = rlbwt(table).agg(F.count("*").alias("runs"), F.count_if(F.col("ch") != "$").alias("runs_of_letters"), F.max("run_len").alias("longest_run"))
    own = table.agg(F.count("*").alias("n"), F.count_if(F.col("bwt") == "$").alias("sequences"), F.max("lcp").alias("longest_lcp"))
    return own.withColumn("one", F.lit(1)).join(runs.withColumn("one", F.lit(1)), "one").select("n", "sequences", "runs", "runs_of_letters", "longest_run", "longest_lcp")


def bit_widths(df: DataFrame) -> DataFrame:
    """(column, bits): what the largest value of each integer column takes."""
    names = [c for c, t in df.dtypes if t in ("bigint", "int")]
    widest = df.agg(*(bit_width(F.coalesce(F.max(c), F.lit(0))).alias(c) for c in names))
    return widest.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("bits")) for c in names))).alias("x")).select("x.*")


def extract(sequences: DataFrame, seq_id: int, first: int, last: int | None = None) -> DataFrame:
    """(seq_id, part): characters first to last (exclusive; None: to the end) of one sequence."""
    size = F.col("len").cast("int") if last is None else F.lit(max(0, last - first))
    return sequences.where(F.col("seq_id") == seq_id).select("seq_id", F.substring("seq", F.lit(first + 1), size).alias("part"))
