import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.llm import fingerprints, langid, mixing, warc
from helixmill.llm.common import connected_components, only_some
from tests.llm.common import HARD, WORD, documents, table


# WARC


def stated_pages(rows):
    out, best = [], {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and page_id is not None:
            best[body] = max(best.get(body, page_id), page_id)
    for page_id, _, html in rows:
        body = (html or "").encode()
        of = best.get(body)
        revisit = of is not None and of != page_id
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", of if revisit else None))
    return sorted(map(str, out))


def pages_of(df):
    return sorted(str(tuple(r)) for r in warc.payloads(warc.read_archives(warc.write_archives(df))).collect())


def test_op3(spark, sf_dir):
    big, copy = "é<b>" * 2_000_000, "c" * 1500
    rows = [(1, "http://a/", copy), (2, None, copy), (2, None, copy), (9, "http://b/ x\r\ny", copy), (None, "http://c/", copy), (3, "u", None), (None, None, None), (4, "u", ""), (5, "u", "s" * 999), (6, "u", "s" * 999), (7, "u", big), (8, "u", big), (None, "u", "n" * 2000), (None, "u", "n" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert pages_of(df) == stated_pages(rows)
    whole = table(spark, sf_dir, "pages")
    assert pages_of(whole) == stated_pages([(r.page_id, r.url, r.html) for r in whole.collect()])
    assert pages_of(spark.createDataFrame([], df.schema)) == []


def test_op3_of_one_payload_that_many_pages_have(spark):
    rows = [(i, "u", "h" * 1200 if i % 3 else f"{i}" * 900) for i in range(1500)] + [(2000 + i, None, "k" * 5000) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as size", "3 as refers_to", "4 as maybe")
    assert pages_of(df) == stated_pages(rows)


def test_chunks_are_bounded_and_add_up(tmp_path):
    out = warc.ArchiveWriter(f"file://{tmp_path}", most=1000)
    body = random.Random(1).randbytes(10_000)
    digest = hashlib.sha1(body).hexdigest()
    out.add(1, "u", body, digest, None)
    out.add(0, "u", body, digest, 1)
    out.close()
    assert [n for _, n in out.done] == [1, 1]
    rows = list(warc.read_chunks(out.done[0][0], chunk=999))
    assert len(rows) == 11 and max(len(r["data"]) for r in rows) == 999 and b"".join(r["data"] for r in rows) == body
    for r in rows:
        assert r["sha1_so_far"] == hashlib.sha1(body[: r["bytes_so_far"]]).hexdigest()
    again = list(warc.read_chunks(out.done[1][0]))
    assert [(r["record_type"], r["refers_to"], r["bytes_so_far"], r["sha1_so_far"]) for r in again] == [("revisit", 1, 10_000, digest)]


# Mixing


def stated_targets(sizes):
    """Sources in order: the excess over three times a source's size is shared again until there is none."""
    weights = [1 + i % 3 for i in range(len(sizes))]
    out, left, active = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while active:
        total = sum(weights[i] for i in active)
        above = {i for i in active if left * weights[i] / total > 3 * sizes[i]}
        if not above:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = 3.0 * sizes[i]
            left -= out[i]
        active -= above
    return out


@pytest.mark.parametrize("which", ["hard", "table"])
def test_op5(spark, sf_dir, which):
    docs = documents(spark, HARD) if which == "hard" else table(spark, sf_dir)
    rows = mixing.mixed(docs).collect()
    again = mixing.mixed(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    own = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    assert sorted(map(str, own)) == sorted(str((r.doc_id, r.source, r["size"])) for r in rows)
    sources = sorted({s for _, s, _ in own}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, s, n in own if s == source) for source in sources]
    for source, size, target in zip(sources, sizes, stated_targets(sizes), strict=True):
        mine = [r for r in rows if r.source == source]
        assert all(r.source_size == size and r.target == pytest.approx(target) for r in mine)
        assert all(0 <= r.taken <= 3 * r["size"] for r in mine)
        assert sum(r.taken for r in mine) == pytest.approx(target, abs=max(3, 0.03 * target))


def test_sainte_lague_equals_the_definition():
    rng = random.Random(2)
    for _ in range(200):
        votes = [rng.choice([0, 1, 5, 5, 100 * rng.random()]) for _ in range(rng.randint(1, 8))]
        seats = rng.randint(0, 40)
        want = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        got = mixing.sainte_lague(votes, seats)
        assert sum(got) == sum(want)
        quotient = lambda s: sorted(round(v / (2 * k + 1), 9) for v, n in zip(votes, s, strict=True) for k in range(n))
        assert quotient(got) == quotient(want)


def test_taken_of_a_stream():
    rng = np.random.default_rng(1)
    for quota in (0, 7, 100, 1234, 5000, 10**6):
        sizes = rng.integers(0, 90, 40)
        taken = mixing.taken_of(sizes, quota, 16, 5)
        assert taken.sum() == min(quota, 3 * sizes.sum()) and (taken <= 3 * sizes).all() and (taken >= 0).all()


def test_shard_quotas_equal_the_definition(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k, source in enumerate(["a", "b", None, "c"]):
        sizes = [rng.choice([0, 7, 1000, 1000, rng.randint(1, 5000)]) for _ in range(rng.randint(1, 30))]
        quota = rng.randint(0, 300)
        rows += [(source, i, x, quota, sum(sizes)) for i, x in enumerate(sizes)]
        want[source] = (sizes, mixing.sainte_lague(sizes, quota))
    got = mixing.shard_quotas(spark.createDataFrame(rows, "of string, shard long, words long, quota long, total long")).collect()
    assert len(got) == len(rows)
    for source, (sizes, seats) in want.items():
        mine = [r.seats for r in sorted((r for r in got if r.of == source), key=lambda r: r.shard)]
        quotient = lambda s: sorted(round(v / (2 * k + 1), 9) for v, n in zip(sizes, s, strict=True) for k in range(n))  # noqa: B023, E731
        assert sum(mine) == sum(seats) and quotient(mine) == quotient(seats)


def test_times_of_a_stream():
    rng = np.random.default_rng(1)
    for quota in (-5, 0, 7, 100, 1234, 5000, 10**6):
        sizes = rng.integers(0, 90, 40)
        times = mixing.times_of(sizes, quota, 16, 5)
        near = min(max(quota, 0), 3 * sizes.sum())
        assert abs((times * sizes).sum() - near) <= sizes.max() / 2 and times.max() <= 3 and times.min() >= 0
    assert mixing.times_of(np.zeros(3, np.int64), 9, 4, 1).tolist() == [0, 0, 0]


def check_mix(docs, slack=0):
    """Whole rows; every source within a document of its target."""
    got = mixing.mix(docs)
    assert got.schema == docs.schema
    before, after = Counter(map(tuple, docs.collect())), Counter(map(tuple, got.collect()))
    assert not set(after) - set(before) and all(n <= 3 * before[r] for r, n in after.items())
    at, text = docs.columns.index("source"), docs.columns.index("text")
    n = lambda r: len(WORD.findall(r[text] or ""))
    assert all(after[r] == k for r, k in before.items() if not n(r))
    sources = sorted({r[at] for r in before}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n(r) * k for r, k in before.items() if r[at] == s) for s in sources]
    for source, target in zip(sources, stated_targets(sizes), strict=True):
        longest = max(n(r) for r in before if r[at] == source)
        assert abs(sum(n(r) * k for r, k in after.items() if r[at] == source) - target) <= longest / 2 + 1 + slack, source
    return after


def test_mix_takes_whole_documents_near_the_targets(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01")
    once = check_mix(docs)
    assert Counter(map(tuple, mixing.mix(docs.repartition(5)).collect())) == once
    check_mix(documents(spark, HARD))
    check_mix(documents(spark, HARD).selectExpr("*", "doc_id as __id", "source as __times", "1 as __ROW_HASH", "'x' as of", "2 as size", "3 as h", "4 as shard"))
    assert mixing.mix(documents(spark, [])).collect() == mixing.mixed(documents(spark, [])).collect() == []
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)  # many shards, and their errors made up in one
    check_mix(docs)


# Language


def test_op6(spark):
    docs = table(spark, "/root/testdata/sf0.01")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identified(docs).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.99 * len(held)
    # predictions read the text alone
    blind = langid.identified(docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))))
    assert sorted(map(str, blind.collect())) == sorted(map(str, rows))


def test_op6_of_hard_rows(spark):
    rows = langid.identified(documents(spark, HARD)).collect()
    assert len(rows) == len(HARD)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].lang_pred == by[2].lang_pred == "und" and by[1].score == 0
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert langid.identified(documents(spark, [])).collect() == []
    nothing = langid.identified(documents(spark, [(1, "some text", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


def test_clashing_columns_of_op5_op6_and_op10(spark):
    docs = documents(spark, HARD)
    clash = docs.selectExpr("*", "1 as size", "2 as taken", "'x' as h", "3 as held_out", "4 as lang_pred", "5 as sketch", "6 as bucket", "7 as ghost", "8 as next_text", "9 as text_hash", "10 as row_hash", "11 as of")
    for f in (mixing.mixed, langid.identified, fingerprints.fingerprint_documents):
        assert sorted(map(str, f(clash).collect())) == sorted(map(str, f(docs).collect()))


def test_op6_learns_more_languages_than_a_mask_has_bits(spark):
    def word(k):
        return "".join(chr(0x4E00 + 40 * k + i) for i in range(12))

    rows = [(100 * k + i, f"{word(k)} {word(k)[::-1]}", f"l{k:03}", "s") for k in range(150) for i in range(4 + k % 3)]
    found = langid.identified(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    of = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == of[r.doc_id] for r in found if any(zlib.crc32(str(d).encode()) % 4 != 2 for d, lang in of.items() if lang == of[r.doc_id]))


def test_op6_counts_equal_sets_of_ngrams(spark):
    docs = table(spark, "/root/testdata/sf0.01")
    model = langid.learn(docs, ~langid.held_out(F.col("doc_id")), sample=1000)  # all of them
    rows = [r for r in docs.collect() if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    of = {}
    for lang in sorted({r.lang for r in rows}):
        mine = [r.text[: langid.SAMPLE_CHARS] for r in rows if r.lang == lang]
        count = {n: Counter(g for t in mine for g in windows(t, n)) for n in langid.SIZES}
        number = lambda g, n: int(langid.grams(np.array([ord(c) for c in g], np.uint32), n)[0])
        of[lang] = {n: set(sorted(c, key=lambda g: (-c[g], number(g, n)))[: langid.KEPT[n]]) for n, c in count.items()}  # noqa: B023
    for r in docs.collect()[:150]:
        own = [sum(sum(g in of[x][n] for g in windows(r.text, n)) / max(1, len(windows(r.text, n))) for n in langid.SIZES) / 3 for x in sorted(of)]
        assert model.shares(langid.letters(r.text)) == pytest.approx(own, abs=0.03)
        if sorted(own)[-1] - sorted(own)[-2] > 0.06:
            assert model.predict(r.text)[0] == sorted(of)[own.index(max(own))]


def windows(text, n):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    low = f" {' '.join(low.split(' '))} "
    while "  " in low:
        low = low.replace("  ", " ")
    return [low[i : i + n] for i in range(len(low) - n + 1)] if low.strip() else []


def test_repeated_rows_count_once_in_the_sample(spark):
    rows = [(5, "the same text again and again", "en", "s")] * 3000 + [(i, f"another text with the number word{i} in it", "en", "s") for i in range(100, 130)]
    labelled = langid.learn(documents(spark, rows), F.lit(True), sample=20)
    assert labelled.languages == ["en"]
    grams = langid.grams(langid.letters("another"), 4)
    assert np.bitwise_and.reduce([labelled.cells[c] for c in langid._cells(grams)]).all()


def test_the_filter_has_every_ngram_it_learned():
    rows = [("aa", "the cat sat on the mat"), ("bb", "der hund und die katze")] * 3
    found = langid.Filter.learned(rows)
    for lang, text in rows:
        k = found.languages.index(lang)
        for n in langid.SIZES:
            g = langid.grams(langid.letters(text), n)
            mask = np.bitwise_and.reduce([found.cells[c] for c in langid._cells(g)])
            assert ((mask >> k) & 1).all()


# Fingerprints


def true_shingles(text):
    words = WORD.findall((text or "").lower())
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, after))
    got = fingerprints.fingerprint_documents(docs).collect()
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(str(w[:3]) for w in want)
    by = {(r.doc_id, r.edited_sha256): r for r in got}
    prints = {}
    for doc_id, _, sha, text, edited, after in want:
        r = by[doc_id, sha]
        a, b, c = map(true_shingles, (text, edited, after))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        exact = len(a | b) <= fingerprints.K
        assert r.near_edited == pytest.approx(jaccard(a, b), abs=1e-9 if exact else 0.25)
        assert r.near_next == pytest.approx(jaccard(a, c), abs=1e-9 if len(a | c) <= fingerprints.K else 0.25)
        assert r.n_shingles == pytest.approx(len(a), rel=0.5)
    return got


def test_op10(spark, sf_dir):
    check_fingerprints(documents(spark, [(7, "alone é here and there", "en", "a")]))
    check_fingerprints(documents(spark, HARD))
    check_fingerprints(table(spark, sf_dir))
    assert fingerprints.fingerprint_documents(documents(spark, [])).collect() == []


@pytest.mark.parametrize("bounds", [2048, 3])
def test_many_buckets_give_the_same_neighbours(spark, sf_dir, monkeypatch, bounds):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    monkeypatch.setattr(fingerprints, "BOUNDS", bounds)  # with 3, most buckets are parts of equal width
    check_fingerprints(table(spark, sf_dir))
    check_fingerprints(documents(spark, HARD))


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(3000)]
    parts = [" ".join(words[:1504]), " ".join(words[1500:])]
    df = spark.createDataFrame([(" ".join(words), *parts)], "whole string, a string, b string")
    s = fingerprints.sketch
    row = df.select(
        s(F.col("whole")).alias("w"), fingerprints.merged(s(F.col("a")), s(F.col("b"))).alias("m"),
        fingerprints.distinct_shingles(s(F.col("whole"))).alias("n"), fingerprints.containment(s(F.col("a")), s(F.col("whole"))).alias("c"), fingerprints.containment(s(F.col("whole")), s(F.col("a"))).alias("d"),
    ).first()
    assert row.w == row.m and len(row.w) == fingerprints.K
    assert row.n == pytest.approx(2996, rel=0.3) and row.c == pytest.approx(1, abs=0.3) and row.d == pytest.approx(0.5, abs=0.2)
    rows = df.select(F.explode(F.array("a", "b")).alias("t")).select(F.lit(1).alias("k"), s(F.col("t")).alias("sketch"))
    assert fingerprints.merge_sketches(rows, "k").first().sketch == row.w


# Shared parts


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, None), (7, 7)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if b is not None and a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {v: root(v) for v in list(parent)} and len(got) == len(parent)


def test_the_filter_lets_all_wanted_rows_through(spark):
    df = spark.range(100_000).withColumn("x", F.col("id") * 7)
    wanted = spark.range(0, 100_000, 500).select(F.col("id").alias("k"))
    got = only_some(df, "id", wanted, "k")
    assert got.join(wanted, got["id"] == wanted["k"], "left_semi").count() == 200
    assert got.count() < 15_000 and got.columns == ["id", "x"]
