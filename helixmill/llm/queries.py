"""The queries opN_<name>: each operator with production parameters over its whole table, and the SQL where it has one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import bpe, fingerprints, langid, mixing, ngram_join, quality, records, secrets, token_counts, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_found(_documents(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(_documents(spark, sf_dir), n=3, num=9, den=10)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.payloads(warc.read_archives(warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


def tokenizer_file(name: str) -> str:
    """A vocabulary of public_tokenizers; HELIXMILL_TOKENIZERS names another folder with files of these names."""
    if folder := os.environ.get("HELIXMILL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("word_bpe_49k.json")
    shards = records.write_records(_documents(spark, sf_dir), lambda: records.chunk_encoder(path, "uint16"), end_id=2, vocabulary=49_408)
    return records.read_records(shards)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(_documents(spark, sf_dir), tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scans": op1_secret_scans,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_warc": op3_warc,
        "op4_token_records": op4_token_records,
        "op5_source_mixing": op5_source_mixing,
        "op6_language_id": op6_language_id,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_counts": op9_token_counts,
        "op10_document_fingerprints": op10_document_fingerprints,
    }


_OP2 = r"""with recursive
w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w),
n as (select doc_id, len(s)::bigint as n from s),
e as (select doc_id, unnest(s) as g from s),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
two as (select x, y from links union all select y, x from links),
reach as (select doc_id as d, doc_id as r from n union select reach.d, two.y from reach join two on reach.r = two.x)
select n.doc_id, n.n as n_shingles, (select min(r) from reach where reach.d = n.doc_id)::bigint as component_id, (select count(*) from two where two.x = n.doc_id)::bigint as n_links from n"""

_OP3 = """with d as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_digest as own, max(page_id) as of_page from d where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when of_page <> page_id then 'revisit' else 'response' end as record_type, case when of_page <> page_id then of_page end as refers_to
from d left join m on payload_digest = own and payload_bytes >= 1000"""


def oracle_sql() -> dict[str, str]:
    """SQL cannot state the other queries: tokenizers, seeded choices, learned models and 64-bit hashes."""
    return {"op2_ngram_jaccard_join": _OP2, "op3_warc": _OP3}
