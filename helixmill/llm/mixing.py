"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's target is a number of words. Blocks of equally many words are allocated to sources by highest quotients
target / 1, target / 3, target / 5, ..., and a source's blocks to its shards in the same way, by the words of the shard. A shard is
a hash part of a source, of bounded size, whose documents in a seeded order make a stream of words. It is taken
as often as its quota holds it whole; the rest is made of blocks in a seeded order, the last of them in part. Where documents
stay whole, those that begin in the first blocks of that order are taken, up to the quota.
"""

from __future__ import annotations

from heapq import heapify, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import stored
from helixmill.llm.native import unused, words
from helixmill.plans.tables import ranked

#: No document is taken more often.
MOST_TIMES = 3
#: Words of a block, at most; it is smaller if a source would get fewer than LEAST_BLOCKS blocks.
BLOCK, LEAST_BLOCKS = 1024, 64
#: Words and documents of a shard, about.
SHARD_WORDS, SHARD_ROWS = 1 << 20, 1 << 14
SEED = 17


def targets(sizes: list[int], weights: list[float], most_times: int = MOST_TIMES) -> list[float]:
    """Words wanted of each source: the sum of all sizes shared by weight, none above most_times its size; the excess is shared anew."""
    out, left, active = [0.0] * len(sizes), sum(sizes), list(range(len(sizes)))
    while active:
        total = sum(weights[i] for i in active)
        above = [i for i in active if left * weights[i] / total > most_times * sizes[i]]
        if not above:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = float(most_times * sizes[i])
            left -= most_times * sizes[i]
        active = [i for i in active if i not in set(above)]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2 s + 1); of equal quotients the earlier party's is higher.

    The quotients above a threshold are counted by rounding; a heap then adds or takes away the few seats that differ.
    """
    total = sum(votes)
    if seats <= 0 or total <= 0:
        return [0] * len(votes)
    out = [int(v * seats / total + 0.5) for v in votes]
    more = seats - sum(out)
    if more > 0:
        heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, out, strict=True))]
    else:
        heap = [(v / (2 * s - 1), -i) for i, (v, s) in enumerate(zip(votes, out, strict=True)) if s]
    heapify(heap)
    for _ in range(abs(more)):
        i = abs(heap[0][1])
        out[i] += 1 if more > 0 else -1
        if more > 0:
            heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
        else:
            heapreplace(heap, (votes[i] / (2 * out[i] - 1) if out[i] else float("inf"), -i))
    return out


def shard_quotas(shards: DataFrame) -> DataFrame:
    """(of, shard, words, seats) from (of, shard, words, quota, total): sainte_lague() of each source's quota among its shards, by columns.

    Seats by rounding come near the result; how near, follows from the seats that are too many or too few in all. So only a few seats
    of each shard are in doubt; their quotients are ranked over all sources at once.
    """
    share = F.col("words") * F.col("quota") / F.greatest("total", F.lit(1))
    base = shards.withColumn("base", F.floor(share + 0.5))
    off = base.groupBy("of").agg((F.first("quota") - F.sum("base")).alias("off")).withColumnRenamed("of", "own")
    base = base.join(off, F.col("of").eqNullSafe(F.col("own"))).drop("own")
    doubt = 2 + F.ceil(F.abs("off") * F.col("words") / F.greatest("total", F.lit(1)))
    base = stored(base.withColumn("doubt", F.when(F.col("words") > 0, doubt).otherwise(0)).withColumn("sure", F.greatest(F.lit(0), F.col("base") - F.col("doubt"))), "doubts")
    seats = base.where("doubt > 0").select("of", "shard", F.explode(F.sequence(F.col("sure") + 1, F.col("base") + F.col("doubt"))).alias("k"), "words")
    seats = ranked(seats.withColumn("quotient", F.col("words") / (2 * F.col("k") - 1)), "at", F.col("of").asc_nulls_first(), F.col("quotient").desc(), F.col("shard"), F.col("k"))
    of = base.groupBy("of").agg((F.first("quota") - F.sum("sure")).alias("open")).join(seats.groupBy(F.col("of").alias("own")).agg(F.min("at").alias("first")), F.col("of").eqNullSafe(F.col("own"))).select("own", "open", "first")
    won = seats.join(of, F.col("of").eqNullSafe(F.col("own"))).where("at - first < open").groupBy(F.col("of").alias("own"), F.col("shard").alias("own_shard")).agg(F.count("*").alias("won"))
    out = base.join(won, F.col("of").eqNullSafe(F.col("own")) & (F.col("shard") == F.col("own_shard")), "left")
    return out.select("of", "shard", "words", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("seats"))


def _blocks(total: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of a stream's blocks, and their seeded order."""
    blocks = -(-total // block)
    length = np.full(blocks, block, np.int64)
    length[-1] = total - (blocks - 1) * block
    return length, np.random.Generator(np.random.PCG64(seed)).permutation(blocks)


def taken_of(sizes: np.ndarray, quota: int, block: int, seed: int) -> np.ndarray:
    """Words taken of each document of a stream, quota in all (at most MOST_TIMES the stream)."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(sizes), np.int64)
    whole, rest = divmod(min(quota, MOST_TIMES * total), total)
    length, order = _blocks(total, block, seed)
    ends = np.cumsum(length[order])
    chosen = np.zeros(len(length) + 1, np.int64)
    chosen[order] = np.clip(rest - (ends - length[order]), 0, length[order])
    before = np.concatenate([[0], np.cumsum(chosen[:-1])])
    place = np.concatenate([[0], np.cumsum(sizes)])
    words_before = before[place // block] + np.minimum(place % block, chosen[place // block])
    return whole * sizes + np.diff(words_before)


def times_of(sizes: np.ndarray, quota: int, block: int, seed: int) -> np.ndarray:
    """How often each document of a stream is taken whole, so that their words come as near quota as the last one in the order lets them."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(sizes), np.int64)
    whole, rest = divmod(min(max(quota, 0), MOST_TIMES * total), total)
    length, order = _blocks(total, block, seed)
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length))
    begins = np.cumsum(sizes) - sizes
    has = np.flatnonzero(sizes)
    has = has[np.argsort(rank[begins[has] // block], kind="stable")]
    upto = np.cumsum(sizes[has])
    n = int(np.searchsorted(upto, rest, "right"))  # the document after these goes beyond the quota
    if n < len(has) and upto[n] - rest < rest - (upto[n - 1] if n else 0):
        n += 1
    out = np.full(len(sizes), whole, np.int64)
    out[has[:n]] += 1
    return out


_KEYS = ("doc_id", "text_hash", "row_hash")


def _dealt(docs: DataFrame, weights: tuple[int, ...], seed: int) -> tuple[DataFrame, int]:
    """docs(doc_id, text, source, row_hash) as rows without texts: their sizes, their source's size and target, and their shard and its quota of words. Also the block."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"), "row_hash")
    sized = stored(sized, "sizes")
    found = sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
    block = max(1, min(BLOCK, int(min((t for t in wanted if t > 0), default=0)) // LEAST_BLOCKS))
    quotas = sainte_lague(wanted, sum(sizes) // block)
    plan = [(r[0], r[1], t, q, max(1, -(-r[1] // SHARD_WORDS), -(-r[2] // SHARD_ROWS))) for r, t, q in zip(found, wanted, quotas, strict=True)]
    plan = spark.createDataFrame(plan, "of string, source_size long, target double, quota long, shards long")
    rows = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_hash", "row_hash")).join(plan, F.col("source").eqNullSafe(F.col("of")), "left")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), "shards"))
    per_shard = rows.groupBy("of", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.first("source_size").alias("total"))
    per_shard = shard_quotas(per_shard).select(F.col("of").alias("own"), F.col("shard").alias("own_shard"), F.least(F.col("seats") * block, MOST_TIMES * F.col("words")).alias("shard_quota"))
    rows = rows.join(per_shard, F.col("source").eqNullSafe(F.col("own")) & (F.col("shard") == F.col("own_shard")))
    return rows.select(*_KEYS, "source", "size", "source_size", "target", "h", "shard", "shard_quota"), block


def _chosen(rows: DataFrame, of, to: str, names: tuple[str, ...], block: int, seed: int) -> DataFrame:
    """rows(names) with to: of() the sizes of a shard's stream."""

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", *_KEYS], kind="stable")
        own = part["source"].iloc[0]
        start = pd.util.hash_array(np.array([f"{seed}:{int(part['shard'].iloc[0])}:{'' if own is None else '=' + own}"], object))[0]
        part[to] = of(part["size"].to_numpy(np.int64), int(part["shard_quota"].iloc[0]), block, int(start))
        return part[[*names, to]]

    types = dict(rows.dtypes)
    return rows.groupBy("source", "shard").applyInPandas(choose, ", ".join(f"{c} {types[c]}" for c in names) + f", {to} long")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken), a row per row of docs.

    size is the number of words of the text (null or empty: 0; a very long one is counted whole), source_size that of its source. Sources in order of code
    points, null last, weigh weights[0], weights[1], ..., repeating. taken is how many words the mix takes, repeats counted,
    at most MOST_TIMES the size; its sum over a source is its target within one block, and one more per shard where a
    target is MOST_TIMES the source. The result depends on the rows and seed alone, not on their order or partitions;
    rows that are equal in doc_id and text may swap what is taken of them. Other columns are not read, whatever their names;
    an empty table gives an empty result. The driver gets a row per source.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.lit(0).cast("long").alias("row_hash"))
    rows, block = _dealt(docs, weights, seed)
    return _chosen(rows, taken_of, "taken", ("doc_id", "text_hash", "source", "size", "source_size", "target"), block, seed)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken, MOST_TIMES at most, and always whole.

    A shard's documents are taken in the seeded order of the blocks in which they begin, up to its quota; what the shards of a source leave
    or take too much is made up in its first one, so that the words of a source come within a document of its target, as far as
    that shard can make up for it. Rows of no words (null and empty texts) stay once; very long texts are taken whole or not. Of rows that
    are equal in every column, any may be the ones taken. All columns are returned as they came, whatever their names; an empty table
    gives an empty result.
    """
    hashed = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.xxhash64(*(F.col(f"`{c}`") for c in hashed)).alias("row_hash"))
    rows, block = _dealt(own, weights, seed)
    names = (*_KEYS, "source", "size", "target", "h", "shard", "shard_quota")
    rows = stored(_chosen(rows, times_of, "times", names, block, seed), "times")
    off = rows.groupBy("source").agg((F.round(F.first("target")) - F.sum(F.col("size") * F.col("times"))).cast("long").alias("off"), F.min(F.when(F.col("size") > 0, F.col("shard"))).alias("at"))
    off = off.select(F.col("source").alias("of"), "off", "at")
    placed = rows.join(F.broadcast(off), F.col("source").eqNullSafe(F.col("of")), "left")  # a row per source, as the driver had
    first = F.coalesce(F.col("shard") == F.col("at"), F.lit(False))
    # the first shard's quota is what it took before and what is missing
    again = placed.where(first).withColumn("took", F.sum(F.col("size") * F.col("times")).over(Window.partitionBy("source", "shard"))).withColumn("shard_quota", F.col("took") + F.col("off"))
    again = _chosen(again.select(*names), times_of, "times", names, block, seed)
    per_row = placed.where(~first).select(*names, "times").unionByName(again).groupBy(*_KEYS[1:]).agg(F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("times"))).alias("times"))
    # a row's two hashes, of its text and of all its columns, are its key: one shuffle of the texts finds copies and their times
    ids = unused(docs, "__text_hash", "__row_hash", "__times")
    per_row = per_row.select(*(F.col(c).alias(name) for c, name in zip((*_KEYS[1:], "times"), ids, strict=True)))
    keyed = docs.withColumns({ids[0]: F.xxhash64("text"), ids[1]: F.xxhash64(*(F.col(f"`{c}`") for c in hashed))}).dropDuplicates(ids[:2])
    out = keyed.join(per_row.where(F.col(ids[2]) > 0), ids[:2])
    return out.withColumn(ids[2], F.explode(F.array_repeat(F.lit(1), F.col(ids[2]).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
