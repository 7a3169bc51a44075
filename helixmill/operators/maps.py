"""Permutations as interval maps: (interval, start, length, dest_interval, dest_offset), a row per run instead of one per position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.runs import f_column, rlbwt, starts_of
from helixmill.operators.suffixes import neighbours
from helixmill.plans.tables import as_of, ranked, running, stored


def size_of(intervals: DataFrame) -> int:
    return intervals.agg(F.sum("length")).first()[0] or 0


def placed(starts: DataFrame, points: DataFrame, n: int, at: str = "at") -> DataFrame:
    """points(at, ...) with dest_interval, the one of starts(interval, start) that holds at, and dest_offset in it, instead of at."""
    own = starts.select(F.col("interval").alias("dest_interval"), F.col("start").alias("own_start"))
    found = as_of(points, at, own, "own_start", ("dest_interval", "own_start"), n)
    return found.withColumn("dest_offset", F.col(at) - F.col("own_start")).drop(at, "own_start")


def _intervals(starts: DataFrame, dest: DataFrame, n: int) -> DataFrame:
    """starts(interval, start, length) and dest(start, at) as an interval map."""
    found = placed(starts, starts.join(dest, "start").select("interval", "start", "length", "at"), n)
    return found.select("interval", "start", "length", "dest_interval", "dest_offset")


def lf_map(table: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """LF over the runs of the BWT. near: neighbours(table), if it is stored already; so below."""
    runs = rlbwt(table).select(F.col("run_id").alias("interval"), "start", F.col("run_len").alias("length"))
    near = neighbours(table) if near is None else near
    return _intervals(runs, near.select(F.col("sa_rank").alias("start"), F.col("lf").alias("at")), table.count())


def psi_starts(runs: DataFrame, mode: str = "dna") -> DataFrame:
    """(interval, start, length) of the runs in the order of F."""
    return starts_of(stored(f_column(runs, mode).select("interval", "length"), "f"))


def psi_map(table: DataFrame, near: DataFrame | None = None, mode: str = "dna") -> DataFrame:
    """Psi over the same runs sorted by character, which is the order of F."""
    near = neighbours(table) if near is None else near
    return _intervals(psi_starts(rlbwt(table), mode), near.select(F.col("sa_rank").alias("start"), F.col("psi").alias("at")), table.count())


def edges(table: DataFrame, side: str) -> DataFrame:
    """(interval, start, length, run_id) of the positions at the tops or bottoms of runs, in text order."""
    at = {"top": F.min("sa_rank"), "bottom": F.max("sa_rank")}[side]
    edge = table.groupBy("run_id").agg(at.alias("sa_rank")).join(table.select("sa_rank", "text_pos"), "sa_rank").select(F.col("text_pos").alias("start"), "run_id")
    edge = ranked(edge, "interval", F.col("start"))
    n = table.count()
    after = edge.select((F.col("interval") - 1).alias("interval"), F.col("start").alias("next"))
    return edge.join(after, "interval", "left").select("interval", "start", (F.coalesce("next", F.lit(n)) - F.col("start")).alias("length"), "run_id")


def phi_map(table: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Phi, the position of the suffix above; intervals start at the tops of runs. sample is the lcp there."""
    return _text_map(table, "top", "phi", 0, near)


def inv_phi_map(table: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Inverse Phi, the position of the suffix below; intervals start at the bottoms of runs. sample is the lcp with it."""
    return _text_map(table, "bottom", "inv_phi", -1, near)


def _text_map(table: DataFrame, side: str, name: str, shift: int, near: DataFrame | None) -> DataFrame:
    near = neighbours(table) if near is None else near
    found = _intervals(edges(table, side), near.select(F.col("text_pos").alias("start"), F.col(name).alias("at")), table.count())
    ranks = table.select((F.col("sa_rank") + shift).alias("k"), F.col("lcp").alias("sample"))
    own = table.select(F.col("text_pos").alias("start"), F.col("sa_rank").alias("k")).join(ranks, "k", "left").select("start", F.coalesce("sample", F.lit(0).cast("long")).alias("sample"))
    return found.join(own, "start").select("interval", "start", "length", "dest_interval", "dest_offset", "sample")


def expanded(intervals: DataFrame) -> DataFrame:
    """(position, dest) of every position of an interval map."""
    rows = intervals.select("dest_interval", "dest_offset", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("k"))
    own = intervals.select(F.col("interval").alias("dest_interval"), F.col("start").alias("to"))
    return rows.join(own, "dest_interval").select((F.col("start") + F.col("k")).alias("position"), (F.col("to") + F.col("dest_offset") + F.col("k")).alias("dest"))


def moved(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """points(interval, offset, ...) after one step of the map: the interval that holds the image, and the offset in it.

    The image is dest_offset + offset places into dest_interval, and may be in a later one; an as-of join finds it.
    """
    own = intervals.select("interval", "dest_interval", "dest_offset")
    to = intervals.select(F.col("interval").alias("dest_interval"), F.col("start").alias("to"))
    rest = [c for c in points.columns if c not in ("interval", "offset")]
    at = points.join(own, "interval").join(to, "dest_interval").select(*rest, (F.col("to") + F.col("dest_offset") + F.col("offset")).alias("at"))
    return placed(intervals, at, size_of(intervals)).select(*rest, F.col("dest_interval").alias("interval"), F.col("dest_offset").alias("offset"))


def previous(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """points(interval, offset, ...) one place earlier, cyclic: the end of the interval before, where offset is 0."""
    n = intervals.count()
    before = intervals.select(F.pmod(F.col("interval") + 1, F.lit(n)).alias("interval"), F.col("length").alias("before"))
    rest = [c for c in points.columns if c not in ("interval", "offset")]
    first = F.col("offset") == 0
    found = points.join(before, "interval")
    return found.select(*rest, F.when(first, F.pmod(F.col("interval") - 1, F.lit(n))).otherwise(F.col("interval")).alias("interval"), F.when(first, F.col("before") - 1).otherwise(F.col("offset") - 1).alias("offset"))


def images(intervals: DataFrame) -> DataFrame:
    """(pi, image, length, at, interval): intervals in the order of their images; pi is the place in it of the given interval pi, whose start is at."""
    own = intervals.select(F.col("interval").alias("dest_interval"), F.col("start").alias("to"))
    rows = intervals.join(own, "dest_interval").select(F.col("interval").alias("pi"), (F.col("to") + F.col("dest_offset")).alias("image"), "length", F.col("start").alias("at"))
    return stored(ranked(rows, "interval", F.col("image")), "images")


def permutations(intervals: DataFrame) -> DataFrame:
    """(interval, pi, inv_pi) of an inversion: interval k of the inverse is the image of interval pi of the given map, and k's own image is at place inv_pi."""
    rows = images(intervals)
    return rows.select("interval", "pi").join(rows.select(F.col("pi").alias("interval"), F.col("interval").alias("inv_pi")), "interval")


def inverted(intervals: DataFrame) -> DataFrame:
    """The inverse map: its intervals are the images of the given ones, in order of their places."""
    found = images(intervals)
    starts = running(found, "interval", "length", "upto").select("interval", (F.col("upto") - F.col("length")).alias("start"), "length", "at")
    out = placed(starts.select("interval", "start"), starts, size_of(intervals))
    return out.select("interval", "start", "length", "dest_interval", "dest_offset")


def isa_samples(table: DataFrame, every: int) -> DataFrame:
    """(text_pos, sa_rank) of every so many text positions."""
    return table.where(F.col("text_pos") % every == 0).select("text_pos", "sa_rank")


def int_at_top(table: DataFrame, mode: str = "dna") -> DataFrame:
    """(interval, phi_interval): the Phi interval that ends where the suffix at the top of an interval of F stands."""
    tops = psi_starts(rlbwt(table), mode).join(table.select(F.col("sa_rank").alias("start"), F.col("text_pos").alias("at")), "start").select("interval", "at")
    return placed(edges(table, "top"), tops, table.count()).select("interval", F.col("dest_interval").alias("phi_interval"))


def int_at_end(table: DataFrame, mode: str = "dna") -> DataFrame:
    """(phi_interval, interval): the inverse of int_at_top()."""
    return int_at_top(table, mode).select("phi_interval", "interval")


def int_at_top_by_run(table: DataFrame) -> DataFrame:
    """(run_id, phi_interval): the Phi interval that starts where the suffix at the top of a run of the BWT stands."""
    return edges(table, "top").select("run_id", F.col("interval").alias("phi_interval"))


def int_at_bottom_by_run(table: DataFrame) -> DataFrame:
    """(run_id, inv_phi_interval): the same for bottoms of runs and inverse Phi."""
    return edges(table, "bottom").select("run_id", F.col("interval").alias("inv_phi_interval"))


def psi_at_run_tops(table: DataFrame, mode: str = "dna") -> DataFrame:
    """(run_id, interval, offset): where the top of each run of the BWT is in the intervals of F."""
    runs = rlbwt(table)
    found = placed(psi_starts(runs, mode), runs.select("run_id", F.col("start").alias("at")), table.count())
    return found.select("run_id", F.col("dest_interval").alias("interval"), F.col("dest_offset").alias("offset"))


def points_of_rows(table: DataFrame, mode: str = "dna") -> DataFrame:
    """(sa_rank, run_id, run_offset, psi_interval, psi_offset, phi_interval, phi_offset): each row of the BWT as a point of the three maps."""
    n, runs = table.count(), rlbwt(table)
    rows = table.join(runs.select("run_id", "start"), "run_id").select("sa_rank", "run_id", (F.col("sa_rank") - F.col("start")).alias("run_offset"), "text_pos", F.col("sa_rank").alias("at"))
    rows = placed(psi_starts(runs, mode), rows, n).withColumnsRenamed({"dest_interval": "psi_interval", "dest_offset": "psi_offset"})
    return placed(edges(table, "top"), rows, n, "text_pos").withColumnsRenamed({"dest_interval": "phi_interval", "dest_offset": "phi_offset"})


def plcp_at(samples: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """points(at, ...) with lcp, from the samples of a Phi map (or of inverse Phi, for the suffix below): the sample of the interval less the offset."""
    found = placed(samples, points, n).join(samples.select(F.col("interval").alias("dest_interval"), "sample"), "dest_interval")
    return found.withColumn("lcp", F.col("sample") - F.col("dest_offset")).drop("dest_interval", "dest_offset", "sample")


def lcp_by_phi(table: DataFrame, phi: DataFrame, inv_phi: DataFrame) -> DataFrame:
    """(sa_rank, by_phi, by_inv_phi): the lcp of each row with the one above, from the samples at its own position and from those below at the other one's."""
    n = table.count()
    own = plcp_at(phi, table.select("sa_rank", F.col("text_pos").alias("at")), n).withColumnRenamed("lcp", "by_phi")
    # the last row's "below" is the first row, cyclic, and the sample there is 0
    above = plcp_at(inv_phi, table.select(F.pmod(F.col("sa_rank") + 1, F.lit(n)).alias("sa_rank"), F.col("text_pos").alias("at")), n).withColumnRenamed("lcp", "by_inv_phi")
    return own.join(above, "sa_rank")


def runs_of_maps(lf: DataFrame, f: DataFrame, psi: DataFrame) -> DataFrame:
    """(run_id, ch, run_len, start) from LF, F(interval, ch) and the intervals of Psi: LF maps the top of a run to the start of the run's interval in F."""
    to = lf.select(F.col("interval").alias("dest_interval"), F.col("start").alias("to"))
    heads = lf.join(to, "dest_interval").select(F.col("interval").alias("run_id"), F.col("length").alias("run_len"), "start", (F.col("to") + F.col("dest_offset")).alias("head"))
    chars = psi.select("interval", F.col("start").alias("head")).join(f.select("interval", "ch"), "interval")
    return heads.join(chars, "head").select("run_id", "ch", "run_len", "start")
