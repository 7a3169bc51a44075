"""An index as a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators.inverse import positions_of_runs, sequences_of
from helixmill.operators.maps import inv_phi_map, lf_map, phi_map, psi_map
from helixmill.operators.runs import rlbwt, run_minima
from helixmill.operators.suffixes import neighbours, suffixes_of
from helixmill.plans.tables import stored

RELATIONS = ("sequences", "suffixes", "rlbwt", "run_minima", "lf", "psi", "phi", "inv_phi")


def save(table: DataFrame, sequences: DataFrame, path: str, mode: str = "dna") -> None:
    """Writes the sequences, the suffix table, the runs, their least lcps and the four interval maps. Each comes from those
    that are written already, so a failure costs the relation at hand."""
    spark = table.sparkSession

    def write(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        return load(spark, path, name)

    write("sequences", sequences)
    table = write("suffixes", table)
    write("rlbwt", rlbwt(table))
    write("run_minima", run_minima(table))
    near = stored(neighbours(table), "neighbours")
    write("lf", lf_map(table, near))
    write("psi", psi_map(table, near, mode))
    write("phi", phi_map(table, near))
    write("inv_phi", inv_phi_map(table, near))


def save_from_runs(runs: DataFrame, path: str, mode: str = "dna") -> None:
    """The same index from a run-length BWT (run_id, ch, run_len, start) alone."""
    found = stored(positions_of_runs(runs, mode), "positions")
    save(suffixes_of(found, mode), sequences_of(found), path, mode)


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(relation, files, bytes) of a stored index."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("relation")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """(relation, n) of a stored index."""
    out = None
    for name in RELATIONS:
        one = load(spark, path, name).agg(F.lit(name).alias("relation"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
