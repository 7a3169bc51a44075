"""The pipeline against brute force, stage by stage, each on its own input."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from helixmill.llm import bpe, mixing, queries, secrets
from tests.llm.common import HARD, documents, table
from tests.llm.test_ngram_join import brute
from tests.llm.test_other_operators import check_mix
from tests.llm.test_quality import stated


def staged(spark, docs, sf_dir, tmp_path):
    """The input and output of each stage, written and read again."""
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        out.append((name, docs, after))
        docs = after
    return out


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("which", ["table", "hard"])
def test_stages(spark, sf_dir, tmp_path, which):
    docs = table(spark, sf_dir) if which == "table" else documents(spark, HARD + [(50 + i, f"these {i} are twelve plain words that should be kept as they are here", "en", "s") for i in range(3)])
    found = staged(spark, docs, sf_dir, tmp_path)
    assert [n for n, _, _ in found] == ["quality rules", "n-gram Jaccard join", "secret scans", "source mixing", "byte-level BPE"]
    for _, before, after in found[:-1]:
        assert after.columns == before.columns

    _, before, after = found[0]  # nothing that fails the base rules stays, and nothing new comes
    assert not rows_of(after) - rows_of(before)
    assert not any(stated(r.text)[-1] for r in after.collect())
    assert after.count() >= 0.75 * sum(not stated(r.text)[-1] for r in before.collect())

    _, before, after = found[1]  # one of each group by brute force
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {d for d, n, component, _ in brute(rows, 5, 8, 10) if d == component}
    assert sorted(map(str, (r.doc_id for r in after.collect()))) == sorted(map(str, want))
    assert not rows_of(after) - rows_of(before)

    _, before, after = found[2]  # no base finding is left, and clean documents are as they were
    clean = {k: n for k, n in rows_of(before).items() if not secrets.base_spans(k[1] or "")}
    assert not any(secrets.base_spans(r.text or "") for r in after.collect())
    assert after.count() == before.count() and sum((Counter(clean) & rows_of(after)).values()) >= 0.99 * sum(clean.values())

    _, before, after = found[3]  # whole rows, every source near its target
    check_mix(before)
    assert rows_of(mixing.mix(before)) == rows_of(after)

    _, before, after = found[4]
    encoding = bpe.loaded(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern())
    want = Counter()
    for r in before.collect():
        ids = encoding.encode(r.text or "")
        want[r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert np.frombuffer(ids, "<u4").max(initial=0) < 50_256
    assert rows_of(after) == want


def test_run_equals_the_stages(spark, sf_dir, tmp_path):
    want = rows_of(staged(spark, table(spark, sf_dir), sf_dir, tmp_path)[-1][2])
    assert rows_of(corpus_pipeline.run(spark, sf_dir)) == want


def test_an_empty_table(spark, sf_dir, tmp_path):
    assert staged(spark, documents(spark, []), sf_dir, tmp_path)[-1][2].count() == 0
