import math
import random
from collections import Counter

import pytest

from helixmill.llm import quality
from tests.llm.common import HARD, WORD, documents, table


def stated(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def rows_of(df):
    return sorted(str((r.doc_id, *(r[f] for f in FIELDS))) for r in df.collect())


def test_base_equals_brute_force(spark, sf_dir):
    rng = random.Random(3)
    more = [(100 + i, "".join(rng.choices(["a", "b", "c", " ", "\n", "\t", "\x0b", "#", "é", "  "], k=rng.randint(0, 120))), "en", "s") for i in range(200)]
    for docs in (documents(spark, HARD + more), table(spark, sf_dir)):
        want = sorted(str((r.doc_id, *stated(r.text))) for r in docs.collect())
        assert rows_of(quality.quality_rules(docs)) == want


def distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    return math.sqrt(max(0, (part(p) + part(q)) / 2))


def histogram(text):
    n = len(text)
    spaces = sum(c in " \t\n\x0b\x0c\r" for c in text)
    counts = [sum("a" <= c <= "z" for c in text), sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text), sum(c > "\x7f" for c in text)]
    return [x / n for x in [*counts, n - sum(counts) - spaces, spaces]]


def test_distances_equal_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01")
    known = {r["lang"]: r for r in quality.references(docs).collect()}
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    for lang, r in known.items():
        own = [t for _, t, own_lang in rows if own_lang == lang]
        words = Counter(w for t in own for w in WORD.findall(t))
        common = sorted((-n, w) for w, n in words.items() if w.isalpha())[: quality.COMMON]
        assert r["common"] == [w for _, w in common]
        assert r["word_shares"][:-1] == pytest.approx([-n / sum(words.values()) for n, _ in common])
        assert r["class_shares"] == pytest.approx([x for x in histogram("".join(own))])
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for doc_id, text, lang in rows:
        words = WORD.findall(text)
        if len(words) < quality.LEAST_WORDS:
            assert got[doc_id].class_distance is None and got[doc_id].kept != got[doc_id].base_failed
            continue
        count, r = Counter(words), known[lang]
        shares = [count[w] / len(words) for w in r["common"]]
        assert got[doc_id].word_distance == pytest.approx(distance([*shares, 1 - sum(shares)], r["word_shares"]), abs=1e-6)
        assert got[doc_id].class_distance == pytest.approx(distance(histogram(text), r["class_shares"]), abs=1e-6)


def test_good_documents_stay_and_most_bad_ones_go(spark):
    docs = table(spark, "/root/testdata/sf0.1")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    rows = quality.quality_rules(docs).join(labels, "doc_id").select("quality", "base_failed", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.999 * len(good)
    assert sum(bad) <= 0.06 * len(bad)


def test_every_language_has_a_reference_whatever_its_script(spark):
    rng = random.Random(8)
    text = lambda words: " ".join(rng.choices(words, k=240))
    cyrillic = ["который", "человек", "сказать", "и", "потому", "другой", "деревня"]
    marked = ["हिन्दी", "में", "किताब", "मेरी", "की", "दिल्ली"]
    langs = {f"l{k:02}": cyrillic for k in range(70)} | {"hi": [w for w in marked if not w.isalpha()]}
    docs = documents(spark, [(100 * k + i, text(words), lang, "s") for k, (lang, words) in enumerate(langs.items()) for i in range(10)])
    known = {r["lang"]: r for r in quality.references(docs).collect()}
    assert set(known) == set(langs) and known["hi"]["common"] == []
    assert set(known["l00"]["common"]) == set(cyrillic)
    rows = quality.quality_rules(docs).collect()
    assert all(r.class_distance is not None and (r.word_distance is None) == (r.doc_id // 100 == 70) for r in rows)


def test_the_verdict_follows_from_the_distances(spark):
    rows = quality.quality_rules(table(spark, "/root/testdata/sf0.01")).collect()
    assert rows[0].__fields__[:8] == ["doc_id", *FIELDS, "kept"]
    for r in rows:
        root = math.sqrt(max(r.n_words, 1))
        far = [d is not None and d > a + b / root for d, (a, b) in ((r.class_distance, quality.CLASS_LIMIT), (r.word_distance, quality.WORD_LIMIT))]
        assert r.kept == (not r.base_failed and not any(far))
    assert any(not r.kept and not r.base_failed for r in rows)


def test_keep_good_returns_the_columns(spark):
    docs = documents(spark, HARD)
    got = quality.keep_good(docs)
    assert got.schema == docs.schema
    good = "these are twelve plain words that should be kept as they are"
    clash = documents(spark, [*HARD, (8, good, "en", "s")]).selectExpr("*", "1 as words", "2 as n", "3 as row", "4 as quality", "5 as hashes", "6 as __words", "7 as kept", "'x' as common", "8 as windows", "9 as class")
    assert sorted(map(str, quality.keep_good(clash).collect())) == sorted(str(r) for r in clash.collect() if not stated(r.text)[-1])
    assert all(not stated(r.text)[-1] for r in got.collect())
    assert quality.quality_rules(documents(spark, [])).collect() == []


def test_native():
    import inspect

    from helixmill.llm import fingerprints, native

    for module in (quality, fingerprints, native):
        source = inspect.getsource(module)
        assert not any(x in source for x in ("pandas", "mapInArrow", "udf", ".rdd", "applyIn"))
