"""Matching statistics of a stream of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixmill.operators.matching import matching_statistics


def pattern_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns(name, seq) from Parquet files as they arrive in a folder."""
    return spark.readStream.schema("name string, seq string").parquet(folder)


def matched_stream(table: DataFrame, patterns: DataFrame, folder: str, checkpoint: str, rule: str = "reference"):
    """Writes the matching statistics of a stream of patterns to Parquet files; returns the started query.

    It takes what is there and ends. Patterns are independent, so there is no state and nothing can be late.
    """
    rows = matching_statistics(table, patterns, rule, on_bad="break")
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
