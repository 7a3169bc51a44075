import hashlib
import math
import random
import re
from collections import Counter

from helixmill.llm import secrets
from tests.llm.common import HARD, documents, table

BASE = {
    "assign": (re.compile("((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def stated(text):
    spans = [(m.start(), list(BASE).index(k), m.end(), k) for k, (p, ok) in BASE.items() for m in p.finditer(text) if ok(m)]
    return [(s, e, k) for s, _, e, k in sorted(spans)]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    parts = ["token", "=", " ", "Password", ":", "api_key", "apikey", "'", '"', "ab", "abcdef", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "ſecret", "toKen", "\n", ".", "é", "=="]
    for _ in range(5000):
        t = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert secrets.base_spans(t) == stated(t), t


def test_whole_table(spark, sf_dir):
    for docs in (documents(spark, HARD), table(spark, sf_dir)):
        texts = [(r.doc_id, r.text or "") for r in docs.collect()]
        want = []
        for doc_id, t in texts:
            spans = stated(t)
            n = Counter(k for _, _, k in spans)
            want.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()))
        got = secrets.secrets_found(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def learned(seed=7):
    words = Counter(re.findall("[A-Za-z-]+", "the quick brown fox jumps over the lazy dog and this long sentence teaches ordinary words-with-hyphens " * 20))
    return secrets.Scanner({k: secrets.Automaton(v) for k, v in secrets.labelled_credentials(200, seed).items()}, secrets.Background(words))


def test_automata_tell_credentials_from_words():
    scan = learned()
    unseen = secrets.labelled_credentials(50, seed=123)
    found = sum(scan.gain(s)[0] >= secrets.LEAST_GAIN for v in unseen.values() for s in v)
    assert found >= 0.95 * sum(map(len, unseen.values()))
    for ordinary in ("quick-brown-fox-jumps-over", "theordinarysentenceteaches", "version-2024-01-lazy-dog"):
        assert scan.gain(ordinary)[0] < secrets.LEAST_GAIN


def test_states_are_merged_and_counts_kept():
    a = secrets.Automaton(["ab" * n for n in range(1, 40)] * 5, alpha=0.05)
    assert len(a.states) < 79
    assert a.states[0].count >= 195
    assert a.bits("abab") > a.bits("zzzz")


def test_the_method_adds_spans_and_base_spans_stay():
    scan = learned()
    bare = secrets.labelled_credentials(1, seed=5)["repository"][0]
    text = f"é see {bare} here, token = 'abcdef123' and 1234567890123456"
    spans = scan.spans(text)
    assert [k for _, _, k in spans] == ["auto", "assign"]
    assert [s for s in spans if s[2] != "auto"] == secrets.base_spans(text)
    assert text[spans[0][0] : spans[0][1]] == bare
    assert secrets.redact(text, spans) == "é see <secret> here, <secret>' and 1234567890123456"


def test_redacted_keeps_rows_and_columns(spark):
    docs = documents(spark, [(1, "x token=abcdef99 y", "en", "a"), (2, None, "en", None), (3, "clean", None, "a"), (3, "clean", None, "a")])
    got = secrets.redacted(docs)
    assert got.schema == docs.schema
    assert sorted(map(str, ((r.doc_id, r.text, r.n_chars) for r in got.collect()))) == sorted(map(str, [(1, "x <secret> y", 12), (2, None, 0), (3, "clean", 5), (3, "clean", 5)]))
    assert secrets.secrets_found(documents(spark, [])).collect() == []


def test_spans_find_held_out_credentials_of_every_format():
    scan = learned()
    for name, found in secrets.labelled_credentials(200, seed=99).items():
        hits = sum((4, 4 + len(s)) in {(b, e) for b, e, _ in scan.spans(f"see {s} here")} for s in found)
        assert hits >= 0.95 * len(found), name
    assert scan.spans("a quick-brown-fox-jumps-over theordinarysentenceteaches version-2024-01-lazy-dog") == []
    assert scan.spans(" ".join(20 * m for m in "-_=/+") + " +-------+-------+ -=-=-=-=-=-=-=-=-=- 1234567890123456") == []


def test_the_background_is_of_all_whole_texts(spark):
    far = "plain " * 1000 + "zqzqzq"
    texts = [far, None, "", "token=abcdef99 a1b2c3"] + [f"word {'abc' * (i % 7)} {i}" for i in range(1500)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)] + [(i, "copies of one text", "en", "a") for i in range(1200)])
    all_texts = [t for t in texts if t] + ["copies of one text"] * 1200
    words = Counter(w for t in all_texts for w in re.findall("[A-Za-z0-9+/_=-]+", t) if sum(c.isdigit() for c in w) < 3 and not stated(w))
    assert secrets.scanner_of(docs).background.share == secrets.Background(words).share
    assert ("z", "q") in secrets.scanner_of(docs).background.share


def naive_gain(scan, s):
    """Likelihoods multiplied out over the stored frequencies, the best format against words."""
    best = -math.inf
    for a in scan.formats.values():
        at, bits = a.states[0], 0.0
        head = a.HEAD if len(s) >= a.HEAD else 0
        for i, c in enumerate(s):
            symbol = f"={c}" if i < head else "a" if c in "abcdefghijklmnopqrstuvwxyz" else "A" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else "0" if c in "0123456789" else c
            if at.seen.get(symbol):
                bits += math.log2(at.seen[symbol] / at.count) + a.emit[symbol].get(c, -8.0)
                at = a.states[at.next[symbol]]
            else:
                bits -= 12
        best = max(best, bits + math.log2(max(at.ends, 0.01) / max(at.count, 1)))
    b = scan.background
    words = sum(math.log2((1 - b.SHARE) * b.share.get((x, y), 0) + b.SHARE * b.PRIOR.get(y, 0.01)) for x, y in zip("^" + s, s, strict=False))
    return (best - words) / len(s)


def test_auto_spans_are_all_candidates_of_enough_likelihood(spark):
    docs = table(spark, "/root/testdata/sf0.01")
    scan = secrets.scanner_of(docs)
    got = {r.doc_id: r for r in secrets.secrets_found(docs, scanner=scan).collect()}
    assert list(next(iter(got.values())).__fields__)[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    clean, false = 0, 0
    for r in docs.collect():
        base = stated(r.text or "")
        auto = [(m.start(), m.end(), "auto") for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", r.text or "") if not any(b <= m.start() and m.end() <= e for b, e, _ in base) and naive_gain(scan, m[0]) >= secrets.LEAST_GAIN]
        want = sorted([*base, *auto], key=lambda s: (s[0], secrets.KINDS.index(s[2]), s[1]))
        assert got[r.doc_id].spans == ",".join(f"{k}:{b}:{e}" for b, e, k in want) and got[r.doc_id].n_auto == len(auto)
        if not base:
            clean, false = clean + 1, false + bool(auto)
    assert false <= 0.01 * clean


def test_a_candidate_that_goes_beyond_a_base_span_is_scored():
    scan = learned()
    token = secrets.labelled_credentials(1, seed=5)["repository"][0]
    spans = scan.spans(f"x 0123456789abcdef01234567{token} y")
    assert [k for _, _, k in spans] == ["hex", "auto"] or [k for _, _, k in spans] == ["auto", "hex"]
    assert [k for _, _, k in scan.spans(f"token={token}")] == ["assign"]
    assert secrets.redact(f"x {token}ab y", [(2, 12, "hex"), (2, 44, "auto")]) == "x <secret> y"


def test_clashing_columns(spark):
    docs = documents(spark, [(1, "x token=abcdef99 y", "en", "a")]).selectExpr("*", "1 as spans", "2 as n_auto", "3 as base_sha256")
    assert [r.n_assign for r in secrets.secrets_found(docs).collect()] == [1]
    assert list(map(tuple, secrets.redacted(docs).collect())) == [(1, "x <secret> y", "en", "a", 12, 1, 2, 3)]
