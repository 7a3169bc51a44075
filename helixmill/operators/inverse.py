"""From a run-length BWT alone: its maps, the texts, and the suffix table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.maps import placed
from helixmill.operators.runs import f_column, starts_of
from helixmill.operators.suffixes import suffixes_of
from helixmill.plans.tables import running, stored
from helixmill.sources.sequences import checked_runs


def placed_in_f(runs: DataFrame, mode: str) -> DataFrame:
    """(run_id, ch, run_len, start, f_start, interval): where each run begins in the BWT and in F."""
    f = stored(f_column(runs, mode), "f")
    starts = starts_of(f.select("interval", "length")).select("interval", F.col("start").alias("f_start"))
    return runs.join(f.select("interval", "run_id"), "run_id").join(starts, "interval").select("run_id", "ch", "run_len", "start", "f_start", "interval")


def ends_of(steps: DataFrame, stop: DataFrame) -> DataFrame:
    """(x, end, dist): where the path of each x ends and after how many steps; steps(x, y) is one to one, and stop(x) ends a path.

    Paths are followed by pointer doubling, log2 of the longest rounds. Rows that have arrived stay out of the joins, so no two rows meet the same one.
    A path that never ends is left out.
    """
    rounds = max(1, steps.count()).bit_length() + 1
    table = stored(steps.select("x", F.col("y").alias("end"), F.lit(1).cast("long").alias("dist"), F.lit(False).alias("done")).join(stop.select(F.col("x").alias("end"), F.lit(True).alias("stops")), "end", "left").select("x", "end", "dist", F.coalesce("stops", F.lit(False)).alias("done")).unionByName(stop.select("x", F.col("x").alias("end"), F.lit(0).cast("long").alias("dist"), F.lit(True).alias("done"))), "paths")
    while rounds and not (open_rows := table.where("not done")).isEmpty():
        rounds -= 1
        later = table.select(F.col("x").alias("end"), F.col("end").alias("later"), F.col("dist").alias("more"), F.col("done").alias("then"))
        after = open_rows.join(later, "end").select("x", F.col("later").alias("end"), (F.col("dist") + F.col("more")).alias("dist"), F.col("then").alias("done"))
        table = stored(table.where("done").unionByName(after), "paths")
    return table.where("done").select("x", "end", "dist")


def positions_of_runs(runs: DataFrame, mode: str = "dna") -> DataFrame:
    """(seq_id, off, text_pos, c, bwt, sa_rank): every position of the texts whose run-length BWT is (run_id, ch, run_len, start).

    Row k is the endmarker of sequence k, as endmarkers are distinct and in the order of sequences. From every row, Psi leads
    through its sequence to its endmarker, which tells the sequence and the place in it.
    """
    placed_runs = stored(placed_in_f(checked_runs(runs), mode), "runs")
    rows = placed_runs.select("ch", (F.col("f_start") - F.col("start")).alias("shift"), F.explode(F.sequence("start", F.col("start") + F.col("run_len") - 1)).alias("row"))
    rows = stored(rows.select("row", "ch", F.when(F.col("ch") != "$", F.col("row") + F.col("shift")).alias("lf")), "rows")
    ends = rows.where("ch = '$'").count()
    steps = rows.where("ch <> '$'").select(F.col("lf").alias("x"), F.col("row").alias("y"))
    found = ends_of(steps, rows.where(F.col("row") < ends).select(F.col("row").alias("x")))
    first = rows.where("ch <> '$'").select(F.col("lf").alias("x"), F.col("ch").alias("c"))
    found = found.join(rows.select(F.col("row").alias("x"), F.col("ch").alias("bwt")), "x").join(first, "x", "left")
    found = stored(found.select(F.col("x").alias("sa_rank"), F.col("end").alias("seq_id"), "dist", F.coalesce("c", F.lit("")).alias("c"), "bwt"), "placed")
    lengths = found.groupBy("seq_id").agg(F.max("dist").alias("len")).withColumn("w", F.col("len") + 1)
    starts = running(lengths, "seq_id", "w", "e").select("seq_id", "len", (F.col("e") - F.col("w")).alias("first"))
    out = found.join(starts, "seq_id")
    return out.select("seq_id", (F.col("len") - F.col("dist")).alias("off"), (F.col("first") + F.col("len") - F.col("dist")).alias("text_pos"), "c", "bwt", "sa_rank")


def sequences_of(positions: DataFrame) -> DataFrame:
    """(seq_id, name, seq, len) from positions; a sequence is one cell of the result."""
    rows = positions.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.when(F.col("c") != "", F.struct("off", "c")))).alias("c"))
    seq = F.array_join(F.transform("c", lambda x: x["c"]), "")
    return rows.select("seq_id", F.col("seq_id").cast("string").alias("name"), seq.alias("seq"), F.size("c").cast("long").alias("len"))


def suffixes_of_runs(runs: DataFrame, mode: str = "dna") -> DataFrame:
    """The suffix table of the texts of a run-length BWT: nothing but the runs is needed. All relations of an index follow from it."""
    return suffixes_of(positions_of_runs(runs, mode), mode)


def lf_of_runs(runs: DataFrame, mode: str = "dna", positions: DataFrame | None = None) -> DataFrame:
    """LF over the runs, from the runs: the k-th run of a character goes behind all smaller characters and the runs of its own before it.

    Endmarkers are put right: the start of sequence k goes to the endmarker of sequence k - 1, cyclic. positions: positions_of_runs(runs), if it is there already.
    """
    positions = positions_of_runs(runs, mode) if positions is None else positions
    own = stored(placed_in_f(checked_runs(runs), mode), "runs")
    ends = own.where("ch = '$'").count()
    starts = positions.where("off = 0").select(F.col("sa_rank").alias("start"), "seq_id")
    to = own.join(starts, "start", "left").select(F.col("run_id").alias("interval"), "start", F.col("run_len").alias("length"), F.when(F.col("ch") == "$", F.pmod(F.col("seq_id") - 1, F.lit(max(ends, 1)))).otherwise(F.col("f_start")).alias("at"))
    found = placed(to.select("interval", "start"), to, own.agg(F.sum("run_len")).first()[0] or 0)
    return found.select("interval", "start", "length", "dest_interval", "dest_offset")


def psi_of_runs(runs: DataFrame, mode: str = "dna", positions: DataFrame | None = None) -> DataFrame:
    """Psi over the runs in the order of F, from the runs: the inverse of lf_of_runs(); endmarker k goes to the start of sequence k + 1, cyclic."""
    positions = positions_of_runs(runs, mode) if positions is None else positions
    own = stored(placed_in_f(checked_runs(runs), mode), "runs")
    ends = own.where("ch = '$'").count()
    starts = positions.where("off = 0").select(F.pmod(F.col("seq_id") - 1, F.lit(max(ends, 1))).alias("f_start"), F.col("sa_rank").alias("first"))
    rows = own.join(starts, "f_start", "left")
    to = rows.select("interval", F.col("f_start").alias("start"), F.col("run_len").alias("length"), F.when(F.col("ch") == "$", F.col("first")).otherwise(F.col("start")).alias("at"))
    found = placed(to.select("interval", "start"), to, own.agg(F.sum("run_len")).first()[0] or 0)
    return found.select("interval", "start", "length", "dest_interval", "dest_offset")
