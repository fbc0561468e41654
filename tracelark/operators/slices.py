"""Very long tracks and threads cut into slices of about as many rows, by a sample of their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelark.sources.shared import shared_path

#: Rows that one task should take of one key in order.
SLICE_ROWS = 1 << 22
#: A stored row takes so many bytes at least, as a rule.
ROW_BYTES = 4
#: Sampled rows for each slice.
SAMPLE = 64
#: Some 40 bytes a cut: 4 MB at most are broadcast.
MOST_BROADCAST = 100_000


def may_be_long(df: DataFrame, slice_rows: int) -> bool:
    """Whether a key of ``df`` could have more than ``slice_rows`` rows, by the bytes that the optimiser knows of what it reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) >= slice_rows * ROW_BYTES


def cuts(rows: DataFrame, keys: list[str], order: list[Column], slice_rows: int = SLICE_ROWS) -> DataFrame | None:
    """Where the rows of keys with more than ``slice_rows`` rows are cut: keys and cuts, an array of places in order.

    None if no key has so many, which ``may_be_long`` tells of small tables without a look at their rows. Rows are sampled by their
    hashes, so cuts depend on the rows alone. Without seeing all, about one row in ``slice_rows`` becomes a cut.
    """
    if not may_be_long(rows, slice_rows):
        return None
    hot = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > slice_rows)
    path = shared_path(rows.sparkSession, "long-keys")
    hot.select(*keys).write.parquet(path)
    hot = rows.sparkSession.read.schema(hot.select(*keys).schema).parquet(path)
    if hot.isEmpty():
        return None
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    each = max(1, slice_rows // SAMPLE)
    sampled = rows.select(*keys, place.alias("place")).where(F.pmod(F.xxhash64("place"), F.lit(each)) == 0).join(hot, keys, "left_semi")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    chosen = sampled.distinct().withColumn("nth", nth).where(F.col("nth") % min(SAMPLE, slice_rows) == 0)
    path = shared_path(rows.sparkSession, "cuts")
    chosen.groupBy(*keys).agg(F.sort_array(F.collect_list("place")).alias("cuts")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def sliced(rows: DataFrame, where: DataFrame, keys: list[str], order: list[Column], name: str = "_slice") -> DataFrame:
    """Adds each row's slice: how many of its key's cuts stand at or before it."""
    number = where.agg(F.sum(F.size("cuts")).alias("n")).first()["n"] or 0
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    joined = rows.withColumn("_place", place).join(F.broadcast(where) if number <= MOST_BROADCAST else where, keys, "left")
    slice_ = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("_place"))), F.lit(0))
    return joined.withColumn(name, F.when(F.col("cuts").isNull(), 0).otherwise(slice_)).drop("cuts", "_place")


def slices_before(cuts: str, at: Column, most: int) -> Column:
    """How many of the rising numbers in the array ``cuts``, ``most`` at most, are at or below ``at``; 0 where the array is null. By halving."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(cuts, n + step - 1) <= at, step).otherwise(0))


def earlier(rows: DataFrame, keys: list[str], **facts: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """Adds what the slices before a row's own amount to: each fact is an aggregate of one slice, and how those combine.

    Facts are null in a key's first slice. Only a row a slice meets by key, and the join is by key and slice.
    """
    sums = rows.groupBy(*keys, "_slice").agg(*(own.alias(name) for name, (own, _) in facts.items()))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums.select(*keys, "_slice", *(combine(name).over(before).alias(name) for name, (_, combine) in facts.items())), [*keys, "_slice"])
