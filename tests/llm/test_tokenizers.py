"""Tokenizers against their libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from helixmill.llm import bpe, queries, records, token_counts
from tests.llm.common import HARD, documents, table

RANKS, WORDS, PIECES = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"
PARTS = [" ", "  ", "\n", "\t", "a", "b", "the", "é", "́", " \n", "\xa0", "　", "\x85", "\x1c", "​", "'s", "'ll", "12", "%", "🙂", "漢", "▁", "<s>", "<|endoftext|>", "\r\n", "aaaa", "ing", "The", "\x00", "====", "Σ", "İ"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return [t or "" for _, t, _, _ in HARD] + ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(3000)]


@pytest.fixture(scope="module")
def ranks():
    return bpe.loaded(queries.tokenizer_file(RANKS), queries.split_pattern())


@pytest.fixture(scope="module")
def tiktoken_encoding(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=queries.split_pattern(), mergeable_ranks=ranks.ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(texts, ranks, tiktoken_encoding):
    for t in texts:
        ids = ranks.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding.encode_ordinary(t)
        assert ranks.decode(ids) == t.encode()


def test_bpe_of_long_pretokens(ranks, tiktoken_encoding):
    rng = random.Random(2)
    for alphabet, n in (("ab", 3000), ("abcdefgh", 50_000), ("é", 2000)):
        t = "".join(rng.choices(alphabet, k=n))
        assert np.frombuffer(ranks.encode(t), "<u4").tolist() == tiktoken_encoding.encode_ordinary(t)
    assert not ranks.buckets and not any(ranks.leaves)


def test_vocabularies_of_any_size(tmp_path):
    words = [*(bytes([i]) for i in range(256)), b"ab", b"abc", b"cab", b"bc", b"aa", b"aaaa"]
    ranks = {w: k if len(w) == 1 else 70_000 + 997 * k for k, w in enumerate(words)}
    (tmp_path / "large.tiktoken").write_bytes(b"".join(base64.b64encode(w) + f" {r}\n".encode() for w, r in ranks.items()))
    own = bpe.ByteBPE(str(tmp_path / "large.tiktoken"), r"\S+|\s+")
    import tiktoken

    library = tiktoken.Encoding("large", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choices("abc ", k=rng.randint(0, 30)))
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_memory_keeps_what_is_asked_for_again(ranks):
    made = []
    memory = bpe.Memory(lambda c: made.append(c) or c.encode(), most=2, longest=3)
    for c in ["a", "b", "a", "c", "a", "long", "long", "d", "a"]:
        assert memory[c] == c.encode()
    assert made.count("a") == 1 and made.count("long") == 2


def test_op7(spark, tiktoken_encoding, sf_dir):
    for docs in (documents(spark, HARD), table(spark, sf_dir)):
        got = bpe.encoding_digests(docs, queries.tokenizer_file(RANKS), queries.split_pattern()).collect()
        want = []
        for r in docs.collect():
            ids = tiktoken_encoding.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    whole = bpe.encoded(documents(spark, HARD), queries.tokenizer_file(RANKS), queries.split_pattern()).collect()
    assert sorted(bytes(r.decoded) for r in whole) == sorted((t or "").encode() for _, t, _, _ in HARD)


def test_counts_equal_the_library(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file(PIECES))
    counter = token_counts.PieceCounter(queries.tokenizer_file(PIECES))
    assert counter.counts(texts) == [len(x) for x in model.encode(texts)]
    counter.MOST = 50
    assert counter.counts(texts[:500]) + counter.counts(texts[500:]) == [len(x) for x in model.encode(texts)]


def test_op9(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file(PIECES))
    for docs in (documents(spark, HARD), table(spark, sf_dir)):
        want = [(r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in docs.collect()]
        got = token_counts.token_counts(docs, queries.tokenizer_file(PIECES)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def library_ids(text):
    from tokenizers import Tokenizer

    global _tokenizer
    if "_tokenizer" not in globals():
        _tokenizer = Tokenizer.from_file(queries.tokenizer_file(WORDS))
    return _tokenizer.encode(text, add_special_tokens=False).ids


def test_chunk_encoder_equals_the_library(texts):
    encode = records.ChunkEncoder(queries.tokenizer_file(WORDS), "uint16")
    encode.chunks.most = encode.parts.most = 300  # forgets all the time
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        assert [x.tolist() for x in encode(part)] == [library_ids(t) for t in part]


def written(docs):
    path = queries.tokenizer_file(WORDS)
    return records.write_records(docs, lambda: records.chunk_encoder(path, "uint16"), end_id=2, vocabulary=49_408)


def test_op4(spark, sf_dir):
    for docs in (documents(spark, HARD), table(spark, sf_dir)):
        rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        want, start = [], 0
        for doc_id, text in rows:
            ids = np.array([*library_ids(text or ""), 2], "<u4")
            want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = records.read_records(written(docs)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_records_can_be_read_by_their_index_and_damage_is_found(spark, tmp_path):
    shard = records.ShardWriter(f"file://{tmp_path}", "s", "uint16")
    for k in range(20):
        shard.add(k if k else None, np.arange(k, dtype=np.uint16))
    shard.close()
    in_order = [(d, x.tolist()) for d, x in records.read_shard(shard.path)]
    shuffled = [(d, x.tolist()) for d, x in records.read_shuffled(shard.path, seed=4)]
    assert in_order == [(k or None, list(range(k))) for k in range(20)]
    assert shuffled != in_order and sorted(map(str, shuffled)) == sorted(map(str, in_order))
    file = tmp_path / "s.uint16.rec"
    data = bytearray(file.read_bytes())
    data[40] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="checksum"):
        list(records.read_shard(shard.path))
    file.write_bytes(bytes(data[:-3]))
    with pytest.raises(ValueError, match="checksum|cut off"):
        list(records.read_shard(shard.path))


def test_clashing_columns(spark):
    docs = documents(spark, [(1, "some text", "en", "a"), (2, None, None, None)]).selectExpr("*", "1 as n_tokens", "2 as start", "3 as ids", "4 as n_bytes", "5 as shard", "6 as ids_sha256")
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in records.read_records(written(docs)).collect()) == [(1, 0, len(library_ids("some text")) + 1), (2, len(library_ids("some text")) + 1, 1)]
    assert sorted((r.doc_id, r.n_bytes) for r in token_counts.token_counts(docs, queries.tokenizer_file(PIECES)).collect()) == [(1, 9), (2, 0)]
    assert sorted((r.doc_id, r.n_tokens > 0) for r in bpe.encoding_digests(docs, queries.tokenizer_file(RANKS), queries.split_pattern()).collect()) == [(1, True), (2, False)]


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert records.read_records(written(empty)).collect() == []
    assert token_counts.token_counts(empty, queries.tokenizer_file(PIECES)).collect() == []
    assert bpe.encoding_digests(empty, queries.tokenizer_file(RANKS), queries.split_pattern()).collect() == []
