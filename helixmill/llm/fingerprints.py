"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's 5-word shingles. Sketches of
parts merge into that of the whole (the k smallest of their union), and two sketches give resemblance,
containment and the number of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import only_some, stored
from helixmill.llm.native import let, window_hashes, word_hashes, words

K = 128
SHINGLE = 5
_SPAN = float(2**64)


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The sketch of a text: lower-cased words, shingles of n words; fewer words are one shingle, none gives an empty sketch."""
    return F.slice(F.sort_array(F.array_distinct(window_hashes(word_hashes(words(F.lower(text))), n))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets of shingles, such as two parts of a text cut with n - 1 words of overlap."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the share of the k smallest of the union that both have. Two empty sketches: 1."""
    union = merged(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63 + 1) / _SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1. An empty a is contained in everything."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits a hash, in the order of the hashes."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def merge_sketches(parts: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch) from the sketches of parts. No array grows beyond k: hashes are ranked, not collected whole."""
    one = parts.select(key, F.explode_outer(column).alias("h")).distinct()
    ranked = one.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("h").asc_nulls_last()))).where(F.col("r") <= k)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))


#: Rows of a bucket, about; so many bounds at most are literals of a plan, and buckets between two of them are of equal width.
BUCKET_ROWS, BOUNDS = 8192, 2048
#: Buckets of a task, about, so that a task stays of one size however many rows there are.
TASK_BUCKETS = 4


def _bucket(doc_id: Column, bounds: list[int], least: int, most: int, fine: int) -> Column:
    """The bucket of a doc_id (-1 for a null): of the ranges between bounds, found by binary search in a literal array, each is cut into fine parts of equal width."""
    ends = F.array(*(F.lit(x).cast("long") for x in [least, *bounds, most + 1]))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))

    def found(p: Column) -> Column:
        low, high = F.get(ends, p).cast("double"), F.get(ends, p + 1).cast("double")
        part = F.floor((doc_id.cast("double") - low) / (high - low) * fine).cast("long")
        return p.cast("long") * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.coalesce(part, F.lit(0))))

    at = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(bounds)) & (F.get(ends, p + s) <= doc_id), p + s).otherwise(p)) if bounds else F.lit(0)
    return F.when(doc_id.isNull(), F.lit(-1).cast("long")).otherwise(let(at, found))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(doc_id, text, *carry) and next_text, next_<carry>: those of the row that follows in order of doc_id (nulls first), then text.

    carry: columns that are made of a text. The last row is followed by the first. Rows are dealt into buckets by quantiles of
    doc_id; the first rows of the next bucket also go, as ghosts, behind the last of the bucket before. So no task has to
    see all rows, and a text is shuffled once. There is a bucket for about BUCKET_ROWS rows, however many that are,
    and a task for TASK_BUCKETS of them, beyond the session's number of shuffle partitions; the driver gets BOUNDS numbers.
    """
    spark, carry = docs.sparkSession, carry or {}
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = docs.count()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = max(-(-n // BUCKET_ROWS), 3 * width if n > 50 * width else 1)
    cuts = [i / min(count, BOUNDS) for i in range(1, min(count, BOUNDS))]
    quantiles = F.percentile_approx("doc_id", cuts, 20 * len(cuts)) if cuts else F.lit(None).cast("array<bigint>")
    found = docs.agg(quantiles.alias("q"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    least, most = found["least"] or 0, found["most"] or 0
    bounds = sorted({x for x in found["q"] or [] if least < x})
    dealt = docs.withColumn("bucket", _bucket(F.col("doc_id"), bounds, least, most, -(-count // BOUNDS)))
    firsts = stored(dealt.groupBy("bucket").agg(F.min(F.struct("doc_id")).alias("first")).select("bucket", F.col("first.doc_id").alias("first")), "buckets")
    order = Window.orderBy("bucket")  # a row per bucket, not per document
    last = firsts.agg(F.max("bucket")).first()[0]
    to = firsts.select(F.col("bucket").alias("own"), "first", F.coalesce(F.lag("bucket").over(order), F.lit(last)).alias("to"))
    ghosts = only_some(dealt, "doc_id", firsts, "first").join(to, (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first")))
    rows = dealt.select("doc_id", "text", "bucket", F.lit(False).alias("ghost")).union(ghosts.select("doc_id", "text", "to", F.lit(True)))
    rows = rows.withColumns({c: f(F.col("text")) for c, f in carry.items()}) if carry else rows
    rows = rows.repartition(max(width, -(-count // TASK_BUCKETS)), "bucket")
    order_by = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.select("doc_id", "text", *carry, "ghost", *(F.lead(c).over(order_by).alias(f"next_{c}") for c in ("text", *carry))).where("not ghost").drop("ghost")


def edited_text(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) characters replaced by the first as many of following, or all of it."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, k: int = K, n: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: its fingerprint, that of its edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles (estimated).
    - A null text counts as the empty one; without words the fingerprint is the empty string, and two such are alike (1.0).
    - A very long text gives all its shingles, and its sketch has k of them at most.
    - Rows follow one another by doc_id (nulls first), then text; equal rows follow each other. A single row follows itself.
    - Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pairs = with_next(texts, carry={"sketch": lambda t: sketch(t, k, n)})
    pairs = pairs.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    pairs = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), k, n).alias("edited_sketch"))
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        F.round(distinct_shingles(F.col("sketch"), k)).cast("long").alias("n_shingles"),
    )
