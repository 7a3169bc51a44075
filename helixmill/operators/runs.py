"""The run-length BWT and what is counted over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.strings import order_key
from helixmill.plans.tables import ranked, running


def rlbwt(table: DataFrame) -> DataFrame:
    """(run_id, ch, run_len, start) of each run; every endmarker is a run of its own."""
    return table.groupBy("run_id").agg(F.first("bwt").alias("ch"), F.count("*").alias("run_len"), F.min("sa_rank").alias("start"))


def run_statistics(runs: DataFrame) -> DataFrame:
    """(ch, runs, symbols, shortest, longest) of each character."""
    return runs.groupBy("ch").agg(F.count("*").alias("runs"), F.sum("run_len").alias("symbols"), F.min("run_len").alias("shortest"), F.max("run_len").alias("longest"))


def by_letter(ch: Column, mode: str) -> Column:
    """What characters of a BWT sort by, the endmarker first."""
    return F.when(ch == "$", F.lit("")).otherwise(order_key(ch) if mode == "dna" else ch)


def f_column(runs: DataFrame, mode: str = "dna") -> DataFrame:
    """(interval, ch, run_id, length): runs sorted by character, then place; interval is the place in F. mode: as for suffixes()."""
    out = ranked(runs.select("ch", "run_id", F.col("run_len").alias("length")), "interval", by_letter(F.col("ch"), mode), F.col("run_id"))
    return out.select("interval", "ch", "run_id", "length")


def cumulative_counts(runs: DataFrame, mode: str = "dna") -> DataFrame:
    """(ch, symbols, before): how many symbols the text has of each character, and of smaller ones. A row per character."""
    counts = runs.groupBy("ch").agg(F.sum("run_len").alias("symbols"))
    order = Window.orderBy(by_letter(F.col("ch"), mode)).rowsBetween(Window.unboundedPreceding, -1)  # of the alphabet's few rows
    return counts.withColumn("before", F.coalesce(F.sum("symbols").over(order), F.lit(0)))


def run_minima(table: DataFrame) -> DataFrame:
    """(run_id, loc, min_lcp): the least lcp in each run, and the last offset from the run's top that has it."""
    return table.groupBy("run_id").agg(F.min(F.struct("lcp", (-F.col("sa_rank")).alias("r"))).alias("m"), F.min("sa_rank").alias("start")).select(
        "run_id", (-F.col("m.r") - F.col("start")).alias("loc"), F.col("m.lcp").alias("min_lcp")
    )


def sequence_run_tops(table: DataFrame) -> DataFrame:
    """(seq_id, len, tops, tops_before, start): the length of each sequence, how many of its positions are tops of runs, and both summed over the sequences before."""
    tops = table.groupBy("run_id").agg(F.min_by("seq_id", "sa_rank").alias("seq_id")).groupBy("seq_id").agg(F.count("*").alias("tops"))
    rows = table.groupBy("seq_id").agg((F.count("*") - 1).alias("len")).join(tops, "seq_id", "left").withColumn("tops", F.coalesce("tops", F.lit(0)))
    rows = running(running(rows.withColumn("w", F.col("len") + 1), "seq_id", "w", "e"), "seq_id", "tops", "t")
    return rows.select("seq_id", "len", "tops", (F.col("t") - F.col("tops")).alias("tops_before"), (F.col("e") - F.col("w")).alias("start"))


def starts_of(lengths: DataFrame) -> DataFrame:
    """(interval, start, length) from (interval, length)."""
    return running(lengths, "interval", "length", "upto").select("interval", (F.col("upto") - F.col("length")).alias("start"), "length")
