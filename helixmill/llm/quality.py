"""Quality rules, in DataFrame functions only: counts per document, and its divergence from its language.

The base rules are fixed: too few words, or too many of them in repeated 5-word windows. The method adds a
verdict: the Jensen-Shannon distance of a document's histograms of character classes and of common words
from those of its language, which are computed over all documents of that language. Distances of short
texts are noise, so there is a least length, and the limit falls with the root of the length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.native import SPACE, jensen_shannon, let, unused, window_hashes, word_hashes, words
from helixmill.plans.tables import stored

WINDOW = 5
#: Common words of a reference.
COMMON = 24
#: No verdict on documents with fewer words.
LEAST_WORDS = 50
#: A reference needs so many documents and words.
LEAST_DOCUMENTS, LEAST_REFERENCE_WORDS = 10, 2000
#: References (about a kilobyte each) up to which they are broadcast.
BROADCAST = 1 << 12
#: A distance is too large beyond base + slope / sqrt(words).
CLASS_LIMIT = (0.20, 0.70)
WORD_LIMIT = (0.16, 1.60)

def char_classes(text: Column, spaces: Column) -> Column:
    """Characters of a text by class: a-z, A-Z, 0-9, beyond ASCII, the rest (marks and controls), the six spaces.

    spaces is the number of the last. Runs of a-z and blanks go first; what is left is short.
    """
    rest = F.regexp_replace(text, "[a-z ]+", "")
    left = lambda r, out: F.char_length(F.regexp_replace(r, out, ""))

    def counted(r: Column) -> Column:
        return F.array(F.char_length(text) - F.char_length(r), left(r, "[^A-Z]+"), left(r, "[^0-9]+"), left(r, "[\\x00-\\x7F]+"), F.char_length(r), left(r, f"[^{SPACE[1:]}+"), spaces)

    def shared(c: Column) -> Column:
        upper, digits, beyond, size, inner, space = (F.get(c, i) for i in range(1, 7))
        return F.array(F.get(c, 0) - (space - inner), upper, digits, beyond, size - upper - digits - beyond - inner, space)

    return let(let(rest, counted), shared)


def _covered(windows: Column, n: int) -> Column:
    """Words in those windows that occur twice or more; windows: hashes in the order of the text."""
    pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def marked(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, k)["w"] == F.get(s, j)["w"], F.lit(False))
        found = F.filter(s, lambda x, j: same(j, F.when(j > 0, j - 1)) | same(j, j + 1))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    steps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(x - F.get(p, F.when(j > 0, j - 1)), F.lit(n))))
    return F.aggregate(let(let(pairs, marked), steps), F.lit(0), lambda t, x: t + x)


def with_repeated_words(df: DataFrame, hashes: str, to: str, n: int = WINDOW) -> DataFrame:
    """df with the number of words in windows of n words that occur twice or more, the first occurrence included.

    Most texts have none, which shows when the distinct windows are counted. A text of fewer than n words has no
    window; window_hashes gives it one, which cannot repeat. hashes: a column of word hashes.
    """
    (windows,) = unused(df, "windows")
    df = df.withColumn(windows, window_hashes(F.col(hashes), n))
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    return df.withColumn(to, F.when(repeated, _covered(F.col(windows), n)).otherwise(F.lit(0))).drop(windows)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}")), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def symbols(text: Column) -> Column:
    bare = text
    for c in "#*$%&|<>":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(bare)


def references(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, common, word_shares, class_shares) of each language with enough text, from all of its documents.

    common has the COMMON most frequent words of letters only (ties by the word), which may be none;
    word_shares their shares of all words, and last that of the rest. Counts are summed in their tasks before they are shuffled.
    """
    texts = docs.select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("lang is not null")
    texts = texts.select("lang", "text", words(F.col("text")).alias("words")).withColumn("spaces", F.char_length("text") - F.char_length(F.array_join("words", "")))
    counted = texts.select("lang", F.size("words").alias("n"), char_classes(F.col("text"), F.col("spaces")).alias("classes"))
    classes = counted.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("words"), *(F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(6)))
    classes = classes.withColumn("all", sum((F.col(f"c{i}") for i in range(1, 6)), F.col("c0")))
    seen = texts.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = seen.where(F.col("word").rlike("^\\p{L}+$")).select("lang", F.struct((-F.col("n")).alias("m"), "word").alias("b"))
    # first the best of 32 parts of a language, then of the language: no window holds a whole vocabulary
    for by in (["lang", F.pmod(F.xxhash64("b.word"), F.lit(32))], ["lang"]):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("b"))).where(F.col("r") <= COMMON)
    best = ranked.groupBy("lang").agg(F.sort_array(F.collect_list("b")).alias("best"))
    out = classes.join(best, "lang", "left").withColumn("best", F.coalesce("best", F.array().cast(best.schema["best"].dataType))).where((F.col("documents") >= LEAST_DOCUMENTS) & (F.col("words") >= LEAST_REFERENCE_WORDS))
    shares = F.transform("best", lambda b: -b["m"] / F.col("words"))
    return out.select(
        "lang", F.transform("best", lambda b: b["word"]).alias("common"),
        F.concat(shares, F.array(1 - F.aggregate(shares, F.lit(0.0), lambda t, x: t + x))).alias("word_shares"),
        F.array(*(F.col(f"c{i}") / F.col("all") for i in range(6))).alias("class_shares"),
    )


def common_shares(hashes: Column, n: Column, common: Column) -> Column:
    """Shares of the common words and of all others among n words; hashes and common: word hashes.

    Written out for each of the COMMON words, so that each count is a loop of compiled code over the array.
    """
    counts = [F.size(hashes) - F.size(F.array_remove(hashes, F.coalesce(F.get(common, F.lit(i)), F.lit(0)))) for i in range(COMMON)]
    known = let(F.array(*counts), lambda c: F.slice(c, F.lit(1), F.size(common)))
    return let(known, lambda c: F.transform(F.concat(c, F.array(n - F.aggregate(c, F.lit(0), lambda t, x: t + x))), lambda x: x / F.greatest(n, F.lit(1))))


def judged(docs: DataFrame, lang: str = "lang", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(row, quality) for each row of docs: its columns in a struct, and a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    - A null text counts as the empty one: no words, so base_failed. A very long text is judged whole.
    - A null lang, or one without a reference, has no distances (null) and is judged by the base rules alone;
      so is a document of fewer than LEAST_WORDS words. A language without words of letters only has no word distance.
    - Repeated rows are judged alike. Columns may have any names. An empty table gives an empty result.
    """
    known = references(docs, lang, text) if known is None else known
    known = stored(known, "references")
    table = known.select("lang", F.transform("common", lambda w: F.xxhash64(w)).alias("common"), "word_shares", "class_shares")
    table = F.broadcast(table) if known.count() <= BROADCAST else table
    body = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("words", words(body)).withColumn("n", F.size("words")).withColumn("hashes", word_hashes(F.col("words")))
    out = out.join(table, F.col(f"row.{lang}") == F.col("lang"), "left")
    long = (F.col("n") >= LEAST_WORDS) & F.col("lang").isNotNull()
    out = with_repeated_words(out, "hashes", "repeat").withColumn("chars", F.char_length(F.array_join("words", "")))
    shares = let(char_classes(body, F.char_length(body) - F.col("chars")), lambda c: F.transform(c, lambda x: x / F.greatest(F.char_length(body), F.lit(1))))
    out = out.withColumns(
        {
            "class": F.when(long, jensen_shannon(shares, F.col("class_shares"))),
            "word": F.when(long & (F.size("common") > 0), jensen_shannon(common_shares(F.col("hashes"), F.col("n"), F.col("common")), F.col("word_shares"))),
            "symbols": symbols(body), "lines": duplicate_lines(body),
        }
    )
    root = F.sqrt(F.greatest("n", F.lit(1)))
    failed = (F.col("n") < 10) | (100 * F.col("repeat") > 20 * F.col("n"))
    far = lambda c, limit: F.coalesce(F.col(c) > limit[0] + limit[1] / root, F.lit(False))
    kept = ~failed & ~far("class", CLASS_LIMIT) & ~far("word", WORD_LIMIT)
    counts = {"n_words": "n", "word_chars": "chars", "n_symbols": "symbols", "n_dup_lines": "lines", "n_repeat_words": "repeat"}
    quality = F.struct(*(F.col(v).cast("long").alias(k) for k, v in counts.items()), failed.alias("base_failed"), kept.alias("kept"), F.col("class").alias("class_distance"), F.col("word").alias("word_distance"))
    return out.select("row", quality.alias("quality"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the quality of judged(), a row per row of docs; an empty table gives an empty result."""
    return judged(docs.select(F.col(doc_id).alias("doc_id"), "text", "lang")).select("row.doc_id", "quality.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, repeated ones too, with all columns as they came, whatever their names.

    A null or an empty text has no words and goes; a null lang is judged by the base rules. An empty table gives an empty result.
    """
    return judged(docs).where("quality.kept").select("row.*")
