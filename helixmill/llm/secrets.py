"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference follows ALERGIA (Carrasco and Oncina, 1994). The labelled credentials of a format make a prefix tree with
counts; states whose frequencies of ending and of each next symbol are compatible by Hoeffding's bound, recursively, are merged.
What is left is a deterministic probabilistic automaton, which gives every string a likelihood. A candidate is scored
by its log-likelihood ratio per character, between the best format and a character model of ordinary tokens.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import slices, texts_of

#: Kinds of base findings in the order in which they are listed; spans of the method follow as "auto".
KINDS = ("assign", "access", "hex", "auto")

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a longest run, so the same as the runs of 20 or more
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, in code points, by start, then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[0], KINDS.index(s[2]), s[1]


def digest_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# Labelled credentials: fixed public formats, filled with seeded random characters.
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_MIXED = _LOWER + _UPPER + _DIGIT
_MARKS = "+/_=-"
_FORMATS = {
    "access_id": (("AKIA", "ASIA"), ((_UPPER + "234567", 16, 16),)),
    "repository": (("ghp_", "gho_", "ghs_", "ghu_"), ((_MIXED, 36, 36),)),
    "chat": (("xoxb-", "xoxp-"), ((_DIGIT, 10, 12), "-", (_DIGIT, 10, 12), "-", (_MIXED, 24, 24))),
    "payment": (("sk_live_", "rk_live_", "sk_test_"), ((_MIXED, 24, 34),)),
    "map": (("AIza",), ((_MIXED + "_-", 35, 35),)),
    "web": (("eyJ",), ((_MIXED + "_-", 30, 60),)),
    "hexadecimal": (("",), (("0123456789abcdef", 32, 64),)),
    "base64": (("",), ((_MIXED + "+/", 40, 60),)),
}


def labelled_credentials(n: int = 400, seed: int = 7) -> dict[str, list[str]]:
    """n credentials of each format."""
    rng = random.Random(seed)

    def filled(parts: tuple) -> str:
        return "".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=rng.randint(p[1], p[2]))) for p in parts)

    return {name: [rng.choice(starts) + filled(parts) for _ in range(n)] for name, (starts, parts) in _FORMATS.items()}


@dataclass
class _State:
    count: int = 0
    ends: int = 0
    next: dict[str, int] = field(default_factory=dict)
    seen: Counter = field(default_factory=Counter)


class Automaton:
    """A deterministic probabilistic automaton over character classes, with the characters' own frequencies per class.

    Prefixes matter by character and bodies by class, so a symbol is the character itself in the first HEAD
    places and its class (lower, upper, digit, other) after them.
    """

    HEAD = 5

    def __init__(self, samples: list[str], alpha: float = 0.01):
        self.states = [_State()]
        chars: dict[str, Counter] = defaultdict(Counter)
        for s in samples:
            self._add(s)
            for symbol, c in zip(self._symbols(s), s, strict=True):
                chars[symbol][c] += 1
        self._merge(alpha)
        self._prune()
        self.emit = {symbol: {c: math.log2(n / sum(found.values())) for c, n in found.items()} for symbol, found in chars.items()}

    def _symbols(self, s: str) -> list[str]:
        head = len(s) >= self.HEAD and [f"={c}" for c in s[: self.HEAD]] or []
        return [*head, *(_class(c) for c in s[len(head) :])]

    def _add(self, s: str) -> None:
        at = self.states[0]
        at.count += 1
        for symbol in self._symbols(s):
            at.seen[symbol] += 1
            if symbol not in at.next:
                at.next[symbol] = len(self.states)
                self.states.append(_State())
            at = self.states[at.next[symbol]]
            at.count += 1
        at.ends += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            p, q = self.states[x], self.states[y]
            if self._differ(p.ends, p.count, q.ends, q.count, bound):
                return False
            for symbol in p.seen.keys() | q.seen.keys():
                if self._differ(p.seen[symbol], p.count, q.seen[symbol], q.count, bound):
                    return False
                if symbol in p.next and symbol in q.next and p.next[symbol] != q.next[symbol]:
                    todo.append((p.next[symbol], q.next[symbol]))  # b is the root of a tree, so this ends
        return True

    def _fold(self, a: int, b: int) -> None:
        """b, the root of a tree, into a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            p, q = self.states[x], self.states[y]
            p.count, p.ends = p.count + q.count, p.ends + q.ends
            for symbol, n in q.seen.items():
                p.seen[symbol] += n
                if symbol in p.next:
                    todo.append((p.next[symbol], q.next[symbol]))
                else:
                    p.next[symbol] = q.next[symbol]

    def _merge(self, alpha: float) -> None:
        """Red states are kept; a blue one, a child of a red, is folded into the first red that it is compatible with, or turns red."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        blue = [(0, symbol) for symbol in sorted(self.states[0].next)]
        while blue:
            parent, symbol = blue.pop(0)
            b = self.states[parent].next[symbol]
            if b in red:
                continue
            for a in red:
                if self._compatible(a, b, bound):
                    self.states[parent].next[symbol] = a
                    self._fold(a, b)
                    break
            else:
                red.append(b)
            blue = [(r, s) for r in red for s in sorted(self.states[r].next) if self.states[r].next[s] not in red]

    def _prune(self) -> None:
        """Only states that can be reached stay."""
        order, at = [0], {0: 0}
        for s in order:
            for t in self.states[s].next.values():
                if t not in at:
                    at[t] = len(order)
                    order.append(t)
        self.states = [self.states[s] for s in order]
        for s in self.states:
            s.next = {symbol: at[t] for symbol, t in s.next.items()}

    def bits(self, s: str) -> float:
        """log2 of the likelihood of s; a step that was never seen costs 12 bits and stays in its state."""
        total, at = 0.0, 0
        for symbol, c in zip(self._symbols(s), s, strict=True):
            state = self.states[at]
            n = state.seen.get(symbol, 0)
            if n:
                total += math.log2(n / state.count) + self.emit[symbol].get(c, -8.0)
                at = state.next[symbol]
            else:
                total -= 12
        state = self.states[at]
        return total + math.log2(max(state.ends, 0.01) / max(state.count, 1))


def _class(c: str) -> str:
    return "a" if c in _LOWER else "A" if c in _UPPER else "0" if c in _DIGIT else c


class Background:
    """A model of ordinary tokens from words of the corpus: each character given the one before, mixed with a small share
    of a prior over character classes, so that what a small corpus never showed costs no more than what a large one did not."""

    SHARE = 0.02
    PRIOR = {**dict.fromkeys(_LOWER, 0.7 / 26), **dict.fromkeys(_DIGIT, 0.15 / 10), **dict.fromkeys(_UPPER, 0.1 / 26)}

    def __init__(self, words: Counter):
        self._learn(self.pairs(words))

    @classmethod
    def of_pairs(cls, pairs: Counter) -> Background:
        out = cls.__new__(cls)
        out._learn(pairs)
        return out

    @staticmethod
    def pairs(words: Counter) -> Counter:
        """How often each character comes after each other one in words of ASCII; "^" is before a word, and in none."""
        if not words:
            return Counter()
        points = np.frombuffer(("^" + "^".join(words)).encode("ascii"), np.uint8).astype(np.int64)
        weights = np.repeat(np.fromiter(words.values(), np.int64), [len(w) + 1 for w in words])
        code = points[:-1] * 128 + points[1:]
        counts = np.bincount(code[points[1:] != 94], weights=weights[1:][points[1:] != 94])  # exact up to 2^53
        return Counter({(chr(c // 128), chr(c % 128)): int(counts[c]) for c in np.flatnonzero(counts).tolist()})

    def _learn(self, pairs: Counter) -> None:
        ones: Counter = Counter()
        for (a, _), n in pairs.items():
            ones[a] += n
        self.share = {(a, b): n / ones[a] for (a, b), n in pairs.items()}
        for a in _DIGIT:  # numbers are ordinary, whether the words show them or not
            self.share |= {(a, b): max(0.08, self.share.get((a, b), 0.0)) for b in _DIGIT}
        for a in _MARKS:  # and so are rules and borders
            self.share |= {(a, b): max(0.2, self.share.get((a, b), 0.0)) for b in _MARKS}

    def bits(self, s: str) -> float:
        return sum(math.log2((1 - self.SHARE) * self.share.get((a, b), 0) + self.SHARE * self.PRIOR.get(b, 0.01)) for a, b in zip("^" + s, s, strict=False))


#: A candidate is a secret if a format explains it better than words by so many bits a character.
LEAST_GAIN = 2.0
#: Tokens with so many digits teach the background model nothing.
LEAST_DIGITS = 3
_NUMBERED = re.compile(f"(?:[0-9][^0-9]*){{{LEAST_DIGITS}}}")


@dataclass
class Scanner:
    formats: dict[str, Automaton]
    background: Background

    def gain(self, s: str) -> tuple[float, str]:
        """Bits a character by which the best format beats the background, and its name."""
        base = self.background.bits(s)
        return max(((a.bits(s) - base) / len(s), name) for name, a in self.formats.items())

    def spans(self, text: str) -> list[Span]:
        """Base spans, and behind them in each place those of candidates that score as credentials, if no base span holds them whole."""
        found = base_spans(text)
        extra = []
        for m in _CANDIDATE.finditer(text):
            if any(b <= m.start() and m.end() <= e for b, e, _ in found):
                continue
            if self.gain(m.group())[0] >= LEAST_GAIN:
                extra.append((m.start(), m.end(), "auto"))
        return sorted(found + extra, key=_order) if extra else found


def ordinary(words: Counter) -> Counter:
    """The words without those that have LEAST_DIGITS digits or a base finding."""
    return Counter({w: n for w, n in words.items() if not _NUMBERED.search(w) and not (len(w) >= 12 and base_spans(w))})  # the shortest finding is token=abcdef


def scanner_of(docs: DataFrame, text: str = "text") -> Scanner:
    """Automata from the labelled credentials, and a background from the words of all whole texts, copies included.

    Character pairs are counted in the tasks and summed; the driver gets a row per pair, a few thousand at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches, "text"):
            words: Counter = Counter()
            for t in texts_of(batch.column(0)):
                words.update(_TOKEN.findall(t))
            total.update(Background.pairs(ordinary(words)))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in total], pa.string()), pa.array([b for _, b in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["a", "b", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = Counter({(r["a"], r["b"]): r["n"] for r in counted.collect()})
    return Scanner({name: Automaton(found) for name, found in labelled_credentials().items()}, Background.of_pairs(pairs))


def secrets_found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_auto) of every whole text.

    Spans are kind:start:end in code points, the end exclusive, by start, then kind, joined by commas. A null or an
    empty text has none (empty string, and its digest); a null doc_id stays null. A very long text is scanned whole, one at a
    time. Repeated rows give repeated results; other columns are not read, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(scanner or scanner_of(docs, text))  # formats and character pairs: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value
        for batch in slices(batches, "text"):
            spans = [scan.spans(t) for t in texts_of(batch.column(1))]
            *counts, auto = [pa.array([sum(s[2] == k for s in x) for x in spans], pa.int64()) for k in KINDS]
            base = [hashlib.sha256(digest_text([s for s in x if s[2] != "auto"]).encode()).hexdigest() for x in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(base, pa.string()), pa.array([digest_text(x) for x in spans], pa.string()), auto],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_auto"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_auto long")


#: What stands for a secret in a text.
REDACTED = "<secret>"


def redact(text: str, spans: list[Span]) -> str:
    """text with every span, or run of spans that touch, replaced."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """docs with secrets replaced in text, and n_chars (if there is one) counted again where a text changed.

    All rows stay, repeated ones too, and all columns, whatever their names. A null and an empty text stay as they are; a very long one is
    scanned and replaced whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(scanner or scanner_of(docs))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value
        for batch in slices(batches, "text"):
            texts = batch.column(at).to_pylist()
            spans = [scan.spans(t) if t else [] for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array([redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) if s else n for t, s, n in zip(columns[at].to_pylist(), spans, columns[k].to_pylist(), strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
