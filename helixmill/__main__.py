"""Command line: build an index from sequences or from a run-length BWT, check it, and ask it.

    python -m helixmill build --input seqs.fa --index DIR [--format fasta|fastq|lines|runs] [--both-strands] [--alphabet dna|strict|text]
    python -m helixmill verify --index DIR [--check lf --check psi --check phi --check inv_phi --check text_by_lf --check text_by_psi]
    python -m helixmill stats --index DIR
    python -m helixmill minlcp --index DIR --output DIR
    python -m helixmill repeats --index DIR --output DIR --kind SM|LM [-L N]
    python -m helixmill match --index DIR --query patterns.fa --output DIR [--query-format fasta|fastq|lines]
                              [--rule reference|min|order|replay|joins] [--record DIR] [--replay DIR] [--files parquet|binary]
    python -m helixmill extract --index DIR --sequence K [--first A] [--last B]

All take --timings, which says what each step took. A rule says which occurrence of a longest match is given: the one that the walk
over the index comes to (reference; joins for an index of any size; replay takes its choices from a recorded walk), or the first in the text (min by the
index, order for a collection of any size).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import matching, repeats, verify, walks
from helixmill.operators.suffixes import suffixes
from helixmill.plans import index_store
from helixmill.plans.shipping import ship
from helixmill.plans.tables import clear, stored
from helixmill.plans.timing import Timer
from helixmill.sources import sequences, sinks


def options(args: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="helixmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    commands = {name: sub.add_parser(name) for name in ("build", "verify", "stats", "minlcp", "repeats", "match", "extract")}
    for p in commands.values():
        p.add_argument("--index", required=True)
        p.add_argument("--timings", action="store_true")
    commands["build"].add_argument("--input", required=True)
    commands["build"].add_argument("--format", choices=("fasta", "fastq", "lines", "runs"), default="fasta")
    commands["build"].add_argument("--both-strands", action="store_true")
    commands["build"].add_argument("--alphabet", choices=("dna", "strict", "text"), default="dna")
    commands["verify"].add_argument("--check", choices=verify.CHECKS, action="append")
    for name in ("minlcp", "repeats", "match"):
        commands[name].add_argument("--output", required=True)
    commands["repeats"].add_argument("--kind", choices=("SM", "LM"), required=True)
    commands["repeats"].add_argument("-L", type=int)
    commands["match"].add_argument("--query", required=True)
    commands["match"].add_argument("--query-format", choices=("fasta", "fastq", "lines"), default="fasta")
    commands["match"].add_argument("--rule", choices=("reference", "min", "order", "replay", "joins"), default="reference")
    commands["match"].add_argument("--record")
    commands["match"].add_argument("--replay")
    commands["match"].add_argument("--files", choices=("parquet", "binary"), default="parquet")
    commands["extract"].add_argument("--sequence", type=int, required=True)
    commands["extract"].add_argument("--first", type=int, default=0)
    commands["extract"].add_argument("--last", type=int)
    found = top.parse_args(args)
    if found.command == "repeats":
        if found.kind == "LM" and found.L is None:
            top.error("LM needs -L")
        if found.L is not None and found.L < 1:
            top.error("-L must be 1 or more")
    if found.command == "match":
        if (found.rule == "replay") != (found.replay is not None):
            top.error("--rule replay and --replay DIR go together")
        if found.record and found.rule != "reference":
            top.error("only the reference rule records its choices")
    return found


_READERS = {"fasta": sequences.from_fasta, "fastq": sequences.from_fastq, "lines": sequences.from_lines}


def build(spark: SparkSession, o: argparse.Namespace, timer: Timer) -> None:
    mode = "text" if o.alphabet == "text" else "dna"
    if o.format == "runs":
        with timer.step("index from runs"):
            return index_store.save_from_runs(spark.read.parquet(o.input), o.index, mode)
    with timer.step("read"):
        rows = _READERS[o.format](spark, o.input)
        names = rows.select(F.col("seq_id").alias("k"), "name")
        rows = sequences.from_table(rows, "seq_id", "seq", o.alphabet, o.both_strands)
        owner = F.floor(F.col("seq_id") / 2) if o.both_strands else F.col("seq_id")
        rows = stored(rows.drop("name").join(names, owner == F.col("k")).select("seq_id", "name", "seq", "len"), "sequences")
    with timer.step("sort suffixes"):
        table = suffixes(rows, mode=mode)
    with timer.step("write"):
        index_store.save(table, rows, o.index, mode)


def match(spark: SparkSession, o: argparse.Namespace, timer: Timer) -> None:
    patterns = stored(_READERS[o.query_format](spark, o.query).select("name", "seq"), "patterns")
    table = index_store.load(spark, o.index, "suffixes")
    with timer.step("match"):
        if o.rule == "order":
            ms = matching.matched_by_order(index_store.load(spark, o.index, "sequences"), patterns)
        elif o.rule == "joins":
            ms = walks.walked(table, index_store.load(spark, o.index, "sequences"), patterns)
        elif o.rule == "replay":
            ms = matching.replayed(table, patterns, spark.read.parquet(o.replay))
        else:
            ms = matching.matching_statistics(table, patterns, o.rule)
        ms = stored(ms, "matches")
    with timer.step("write"):
        if o.files == "parquet":
            ms.write.parquet(o.output)
        else:
            sinks.write_matching(matching.arrays(ms, patterns), o.output).collect()
    if o.record:
        recorded = matching.repositionings(table, patterns)
        recorded.write.parquet(o.record)
        sinks.write_counters(matching.counters(ms, spark.read.parquet(o.record)), timer.seconds["match"], f"{o.record}.stats")


def main(args: list[str], spark: SparkSession | None = None) -> int:
    o = options(args)
    given = spark is not None
    spark = ship(spark or SparkSession.builder.appName("helixmill").getOrCreate())
    timer = Timer(print if o.timings else None)
    try:
        with timer.step(o.command):
            return _run(spark, o, timer)
    finally:
        if not given:  # a session of one's own may still use its tables
            clear(spark)


def _run(spark: SparkSession, o: argparse.Namespace, timer: Timer) -> int:
    load = lambda name: index_store.load(spark, o.index, name)
    if o.command == "build":
        build(spark, o, timer)
    elif o.command == "verify":
        checks = verify.verify(load("suffixes"), load("sequences"), tuple(o.check or verify.CHECKS), {k: load(k) for k in ("lf", "psi", "phi", "inv_phi")}).collect()
        print(*(f"{r.check}\t{'ok' if r.ok else 'FAILED'}\t{r.detail}" for r in checks), sep="\n")
        return int(not all(r.ok for r in checks))
    elif o.command == "stats":
        print(*(f"{k}\t{v}" for k, v in verify.statistics(load("suffixes")).first().asDict().items()), sep="\n")
        print(*(f"bytes of {r.relation}\t{r.bytes}" for r in index_store.sizes(spark, o.index).orderBy("relation").collect()), sep="\n")
    elif o.command == "minlcp":
        sinks.write_run_minima(load("run_minima"), o.output)
    elif o.command == "repeats":
        table: DataFrame = load("suffixes")
        sinks.write_tsv(repeats.supermaximal_repeats(table, o.L or 1) if o.kind == "SM" else repeats.maximal_repeats(table, o.L), o.output)
    elif o.command == "match":
        match(spark, o, timer)
    else:
        for r in verify.extract(load("sequences"), o.sequence, o.first, o.last).collect():
            print(r.part)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
