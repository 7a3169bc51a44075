"""Collections of sequences as a relation: sequences(seq_id, name, seq, len), seq_id from 0 without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.strings import dna, only_dna, reverse_complement
from helixmill.plans.tables import ranked, running, stored

_COLUMNS = ("seq_id", "name", "seq", "len")


def from_table(df: DataFrame, key: str, text: str, mode: str = "dna", both_strands: bool = False) -> DataFrame:
    """A sequence per row, numbered in order of key. mode "text" takes the text as it is, "dna" with N for all that is not of ACGTN, in upper
    case, so that no place shifts; "strict" raises for anything but ACGTN.

    An empty sequence is one (it has an endmarker), as is a null text. With both_strands, row k gives
    sequences 2 k and 2 k + 1, the second being the reverse complement.
    """
    if mode not in (kinds := {"dna": dna, "text": lambda c: c, "strict": only_dna}):
        raise ValueError(f"mode: {mode}")
    body: Column = F.coalesce(F.col(text), F.lit(""))
    rows = ranked(df.select(F.col(key).cast("string").alias("name"), F.col(key).alias("__key"), kinds[mode](body).alias("seq")), "seq_id", F.col("__key").asc_nulls_first(), F.col("seq"))
    if both_strands:
        rows = rows.withColumn("__s", F.explode(F.array(F.lit(0), F.lit(1))))
        rows = rows.withColumn("seq", F.when(F.col("__s") == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).withColumn("seq_id", F.col("seq_id") * 2 + F.col("__s"))
    return rows.withColumn("len", F.length("seq").cast("long")).select(*_COLUMNS)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(k, value): the lines of files, k in order of the files' names and of the place in them."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    return stored(lines.select(F.struct("f", "b", "i").alias("k"), "value"), "lines")


def numbered(patterns: DataFrame) -> DataFrame:
    """(k, name, seq) of patterns(name, seq), k from 0 in order of the names; a null seq is empty."""
    return from_table(patterns.select("name", "seq"), "name", "seq", "text").select(F.col("seq_id").alias("k"), "name", "seq")


def from_lines(spark: SparkSession, path: str, both_strands: bool = False) -> DataFrame:
    """A sequence per line, in the order of the files' lines. Lines are numbered by file and place in it."""
    rows = ranked(_lines(spark, path), "n", F.col("k"))
    return from_table(rows.select("n", "value"), "n", "value", "text", both_strands)


def from_words(df: DataFrame, text: str, key: str | None = None) -> DataFrame:
    """A sequence per run of characters other than white space, in order of key (None: one row is all there is), then of the text."""
    words = df.select((F.lit(0) if key is None else F.col(key)).alias("t"), F.posexplode(F.filter(F.split(F.col(text), "\\s+"), lambda w: w != "")).alias("n", "w"))
    rows = ranked(words, "at", F.col("t").asc_nulls_first(), F.col("n"))
    return from_table(rows, "at", "w", "text")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, file, value): lines numbered over all files, in order of the files' names."""
    rows = ranked(_lines(spark, path), "n", F.col("k"))
    return rows.select("n", F.col("k.f").alias("file"), F.regexp_replace("value", "\\r$", "").alias("value"))


def from_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files, ">name comment" and lines of sequence. A record without sequence is an empty sequence.

    A record begins at a line that begins with ">"; a ">" elsewhere is a character like others. Lines before the first record
    of all must be empty. Files may be split anywhere between lines; a record belongs to the lines behind its header, in the order of the files' names.
    """
    lines = _numbered_lines(spark, path).withColumn("head", F.when(F.col("value").startswith(">"), 1).otherwise(0))
    lines = stored(running(lines, "n", "head", "record"), "lines")
    if not lines.where("record = 0 and trim(value) <> ''").isEmpty():
        raise ValueError("a FASTA file begins with another line than a header")
    bodies = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("head") == 0, F.struct("n", F.regexp_replace("value", "\\s", "").alias("v"))))), lambda x: x["v"]), "")
    rows = lines.where("record > 0").groupBy("record").agg(F.max(F.when(F.col("head") == 1, F.col("value"))).alias("h"), bodies.alias("seq"))
    return rows.select((F.col("record") - 1).alias("seq_id"), F.split(F.expr("substring(h, 2)"), "\\s", 2)[0].alias("name"), "seq", F.length("seq").cast("long").alias("len"))


def from_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTQ files with four lines each: "@name comment", sequence, "+", qualities. Lines are counted in each file, however it is split."""
    lines = _numbered_lines(spark, path)
    first = lines.groupBy(F.col("file").alias("own")).agg(F.min("n").alias("first"), F.max(F.when(F.col("value") != "", F.col("n"))).alias("last"))
    lines = lines.join(first, F.col("file") == F.col("own")).where("n <= last").withColumn("at", F.col("n") - F.col("first"))
    part = lambda i: F.max(F.when(F.col("at") % 4 == i, F.col("value")))
    rows = stored(lines.groupBy("file", F.floor(F.col("at") / 4).alias("r")).agg(part(0).alias("h"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("q")), "records")
    bad = rows.where("not coalesce(startswith(h, '@') and startswith(plus, '+') and length(seq) = length(coalesce(q, '')), false)").count()
    if bad:
        raise ValueError(f"{bad} records are not of four lines, with a quality for each base")
    rows = ranked(rows, "seq_id", F.col("file"), F.col("r"))
    return rows.select("seq_id", F.split(F.expr("substring(h, 2)"), "\\s", 2)[0].alias("name"), "seq", F.length("seq").cast("long").alias("len"))


def checked_runs(runs: DataFrame) -> DataFrame:
    """A run-length BWT (run_id, ch, run_len, start), after a check of its invariants."""
    bad = runs.where("run_len < 1 or (ch = '$' and run_len > 1) or length(ch) <> 1").count()
    if bad:
        raise ValueError(f"{bad} runs break the invariants: a length of 1 or more, an endmarker a run of its own, one character")
    return runs


def from_runs(runs: DataFrame) -> DataFrame:
    """(sa_rank, bwt) of a run-length BWT (run_id, ch, run_len, start); operators.inverse makes texts and suffix tables from one."""
    return checked_runs(runs).select(F.explode(F.sequence("start", F.col("start") + F.col("run_len") - 1)).alias("sa_rank"), F.col("ch").alias("bwt"))


def generated(spark: SparkSession, n: int, shortest: int, longest: int, seed: int, both_strands: bool = True) -> DataFrame:
    """n random sequences over ACGT, of shortest to longest characters; the same for the same seed."""
    rows = spark.range(n).withColumn("length", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(longest - shortest + 1)) + shortest)
    letters = F.transform(F.sequence(F.lit(1), F.col("length")), lambda i: F.substring(F.lit("ACGT"), F.pmod(F.xxhash64(F.lit(seed + 1), "id", i), F.lit(4)).cast("int") + 1, F.lit(1)))
    rows = rows.select("id", F.when(F.col("length") > 0, F.array_join(letters, "")).otherwise("").alias("seq"))
    return from_table(rows, "id", "seq", "text", both_strands)


def cropped(sequences: DataFrame, share: float) -> DataFrame:
    """The first share of the sequences, and the first share of each."""
    n = int(sequences.count() * share)
    kept = sequences.where(F.col("seq_id") < n).withColumn("seq", F.substring("seq", F.lit(1), F.floor(F.col("len") * share).cast("int")))
    return kept.withColumn("len", F.length("seq").cast("long")).select(*_COLUMNS)


def starts(sequences: DataFrame) -> DataFrame:
    """(seq_id, start): the text position of each sequence; every sequence before it has an endmarker."""
    return running(sequences.select("seq_id", (F.col("len") + 1).alias("w")), "seq_id", "w", "e").select("seq_id", (F.col("e") - F.col("w")).alias("start"))


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """(name, len) of a length file: name and length with a tab or a space between."""
    parts = spark.read.text(path).where("value <> ''").select(F.split("value", "[\\t ]+").alias("p"))
    return parts.select(F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).cast("long").alias("len"))
