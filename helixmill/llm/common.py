"""What the operators share: slices of Arrow batches, 64-bit mixing, components of a graph."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.plans.tables import new_folder, stored

__all__ = ["WORD", "connected_components", "flagged", "give_back", "join_hot", "mix", "new_folder", "only_some", "slices", "stored", "texts_of"]

#: A word, for every operator here: characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column, a null as the empty string."""
    return ["" if x is None else x for x in column.to_pylist()]


def give_back() -> None:
    """Returns free memory to the system, so that a worker that waits for its next task holds no more than it needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with this C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices with at most most_bytes of text, or one row: bounds what a kernel holds."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        width = 64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else 32
        ends = np.frombuffer(column.buffers()[1], dtype=f"int{width}")[column.offset + 1 : column.offset + 1 + len(column)]
        at, base = 0, int(np.frombuffer(column.buffers()[1], dtype=f"int{width}")[column.offset])
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at, base = to, int(ends[to - 1])
        del batch, column, ends
        give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


#: A key of more rows than HOT is hot, and of more if there would be over MOST_HOT such keys.
HOT, MOST_HOT = 256, 50_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """The inner or left join of rows with table on key, where a key may have any share of the rows.

    table has a row per key; n is its number of rows, total the sum of those. The rows of hot keys stay where they are
    and meet their row of table by a broadcast; each has over total / MOST_HOT rows, so there are at most MOST_HOT. All other
    rows are joined by key.
    """
    most = max(HOT, total // MOST_HOT)
    hot = F.broadcast(table.where(F.col(n) > most))
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(n) <= most), key, how))


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each is one aggregation and
    one join on the node, neither needs the rows of a component in one place (join_hot), and the edges never grow in
    number. It ends when a round changes nothing, after O(log^2 n) rounds at most. Every step is stored.
    An edge from a node to itself or with a null end is ignored, as are repeated edges.
    """
    e = stored(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before, n = None, e.count()
    for _ in range(most_rounds):
        if not n:
            break
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        e = stored(join_hot(both.where("b > a"), least, "a", "n", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        least = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = join_hot(e, least, "a", "n", n).select("a", "b", "m")
        e = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        e = stored(e.distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: Bits of the filter of only_some(), at most: 8 MB.
FILTER_BITS = 1 << 26


def only_some(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """df with nearly only the rows whose key is among those of wanted, all of these included; ahead of a join, to shuffle less."""
    return flagged(df, key, wanted, wanted_key, "__wanted").where("__wanted").drop("__wanted")


def flagged(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, to: str) -> DataFrame:
    """df with a boolean to: false only where key is not among those of wanted.

    A bitmap of the hashed keys is broadcast: 16 bits a key, in pieces of 4 KB, and FILTER_BITS at most. With
    more keys than that it flags more rows, and the join that follows does the rest.
    """
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(bits)) + 1
    pieces = wanted.select(place(wanted_key).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    found = df.withColumn("__p", place(key)).withColumn("__of", F.bitmap_bucket_number("__p")).withColumn("__p", F.bitmap_bit_position("__p"))
    found = found.join(F.broadcast(pieces), F.col("__of") == F.col("__piece"), "left")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.select(*df.columns, F.coalesce(F.getbit(byte, (F.col("__p") % 8).cast("int")) == 1, F.lit(False)).alias(to))
