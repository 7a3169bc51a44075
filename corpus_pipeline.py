"""A corpus pipeline over documents: quality, near duplicates, secrets, the mix of sources, token ids.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import bpe, mixing, ngram_join, quality, queries, secrets
from helixmill.llm.common import stored
from helixmill.plans.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return ngram_join.one_of_each(docs, n=5, num=8, den=10)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return secrets.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources takes them, which may be never."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, by digest, and that they decode to its text. Workers have served other stages, so they remember less."""
    return bpe.encoding_digests(docs, queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern(), remember=120_000)


def _shipped(stage):
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [
    ("quality rules", _shipped(quality_rules)),
    ("n-gram Jaccard join", _shipped(ngram_jaccard_join)),
    ("secret scans", _shipped(secret_scans)),
    ("source mixing", _shipped(source_mixing)),
    ("byte-level BPE", _shipped(byte_bpe)),
]

#: SQL has neither the tokenizer nor the automata; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
