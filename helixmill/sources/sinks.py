"""Results as text and binary files."""

from __future__ import annotations

import io
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.plans.tables import stored


def write_fasta(sequences: DataFrame, path: str) -> None:
    """A record per sequence, in order of seq_id across the files' names."""
    rows = sequences.repartitionByRange("seq_id").sortWithinPartitions("seq_id")
    rows.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq")).write.text(path)


def write_fastq(sequences: DataFrame, path: str) -> None:
    """Four lines per sequence, in order of seq_id across the files' names; the qualities are all the best."""
    rows = sequences.repartitionByRange("seq_id").sortWithinPartitions("seq_id")
    rows.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))).write.text(path)


def write_run_minima(minima: DataFrame, path: str) -> None:
    """A line ( loc, min) per run, in order of the runs."""
    rows = minima.repartitionByRange("run_id").sortWithinPartitions("run_id")
    rows.select(F.format_string("( %d, %d)", "loc", "min_lcp")).write.text(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """A header and a line per row, columns separated by tabs; arrays of structs are appended as trailing columns, which the header does not name.

    The first file has the header alone, so the files in order of their names are one table.
    """
    kinds = dict(rows.dtypes)
    flat = [F.array_join(F.flatten(F.transform(c, lambda x: F.array(x["seq"].cast("string"), x["pos"].cast("string")))), "\t") if t.startswith("array") else F.col(c).cast("string") for c, t in kinds.items()]
    names = [c for c, t in kinds.items() if not t.startswith("array")]
    lines = rows.select(F.rtrim(F.concat_ws("\t", *flat), F.lit("\t")).alias("value"))
    header = rows.sparkSession.range(1).coalesce(1).select(F.lit("\t".join(names)).alias("value"))
    header.union(lines).write.text(path)


def write_counters(counters: DataFrame, seconds: float, path: str) -> None:
    """Lines of name and value for a whole run: patterns, characters, mismatches, matched characters, and nanoseconds a character."""
    total = counters.agg(F.count("*").alias("patterns"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("characters", "mismatches", "matched")))
    total = total.withColumn("ns_per_character", F.round(F.lit(seconds * 1e9) / F.greatest("characters", F.lit(1)), 3))
    total.select(F.explode(F.array(*(F.concat_ws("\t", F.lit(c), F.col(c).cast("string")) for c in total.columns))).alias("value")).coalesce(1).write.text(path)


def write_matching(ms: DataFrame, folder: str) -> DataFrame:
    """Binary files of lengths and positions: ">name", line feed, the count in 8 bytes, the values (4 and 8 bytes), line feed.

    ms has a row per pattern: name and the arrays lens and poss, as matching.arrays() gives them. Each task writes files of its
    own; returns the stored table (kind, path) of the files of tasks that ended well.
    """
    import pyarrow.fs

    def run(batches):
        import pandas as pd

        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        names = {kind: f"{uuid.uuid4().hex}.{kind}" for kind in ("len", "pos")}
        files = {kind: fs.open_output_stream(f"{at}/{name}") for kind, name in names.items()}
        for pdf in batches:
            for name, lens, poss in zip(pdf["name"], pdf["lens"], pdf["poss"], strict=True):
                for kind, values, code in (("len", lens, "I"), ("pos", poss, "Q")):
                    files[kind].write(f">{name}\n".encode() + struct.pack(f"<Q{len(values)}{code}", len(values), *map(int, values)) + b"\n")
        for f in files.values():
            f.close()
        yield pd.DataFrame({"kind": list(names), "path": [f"{folder}/{n}" for n in names.values()]})

    return stored(ms.select("name", "lens", "poss").mapInPandas(run, "kind string, path string"), "files")


def read_matching(path: str) -> list[tuple[str, list[int]]]:
    """(name, values) of one file of write_matching(); its kind is the end of its name."""
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    size, code = (4, "I") if path.endswith(".len") else (8, "Q")
    out = []
    with fs.open_input_stream(at, buffer_size=1 << 20) as raw:
        f = io.BufferedReader(raw, 1 << 20)
        while head := f.readline():
            (n,) = struct.unpack("<Q", f.read(8))
            out.append((head[1:-1].decode(), list(struct.unpack(f"<{n}{code}", f.read(n * size)))))
            if f.read(1) != b"\n":
                raise ValueError(f"{path}: a record doesn't end where it says")
    return out
