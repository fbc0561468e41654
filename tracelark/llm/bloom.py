"""A blocked Bloom filter made of DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Four 64-bit words a block; a key sets one bit in each.
WORDS = 4
#: A filter never exceeds this many blocks (4 MB), whatever the number of keys; more keys only let more
#: false positives through to the exact join behind it.
MAX_BLOCKS = 1 << 17


def blocks_for(keys: int) -> int:
    """Blocks for about 12 bits a key, as a power of two within bounds."""
    return min(MAX_BLOCKS, max(64, 1 << (keys * 12 // (64 * WORDS)).bit_length()))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    place = F.pmod(F.xxhash64(key, F.lit(word)), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def bloom_words(keys: DataFrame, blocks: int) -> DataFrame:
    """One row, one column ``words``: the filter over column ``key`` as ``blocks * 4`` longs in order."""
    filled = (
        keys.select(_block(F.col("key"), blocks).alias("block"), *(_bit(F.col("key"), w).alias(f"w{w}") for w in range(WORDS)))
        .groupBy("block")
        .agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)))
    )
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    block = F.array(*(F.coalesce(f"w{w}", F.lit(0).cast("bigint")) for w in range(WORDS)))
    whole = every.join(filled, "block", "left").select(F.struct("block", block.alias("w")).alias("b"))
    return whole.agg(F.flatten(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["w"])).alias("words"))


def with_hits(rows: DataFrame, keys: DataFrame, blocks: int, key: Column, name: str) -> DataFrame:
    """``rows`` and whether the filter over column ``key`` of ``keys`` may hold ``key``, as column ``name``.

    The filter comes as a broadcast row. As a scalar subquery it would be planned anew wherever its words are named,
    and wherever Spark copies that condition: 8 to 16 plans for each filter, all in the driver's memory.
    """
    words = bloom_words(keys, blocks).withColumnRenamed("words", "_words")
    return rows.crossJoin(F.broadcast(words)).withColumn(name, might_contain(F.col("_words"), key, blocks)).drop("_words")


def might_contain(words: Column, key: Column, blocks: int) -> Column:
    """Whether the filter in ``words`` may hold ``key``; never false for a key that it holds."""
    at = _block(key, blocks) * WORDS
    hits = [F.get(words, at + w).bitwiseAND(_bit(key, w)) != 0 for w in range(WORDS)]
    return hits[0] & hits[1] & hits[2] & hits[3]
