"""The relations of a stored index as temporary views, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from helixmill.plans.index_store import RELATIONS, load


def create_views(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """A temporary view <prefix><relation> for each relation of the index at path; returns their names."""
    names = [f"{prefix}{name}" for name in RELATIONS]
    for name, relation in zip(names, RELATIONS, strict=True):
        load(spark, path, relation).createOrReplaceTempView(name)
    return names
