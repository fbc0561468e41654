"""Begin and end events become spans, by windows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelark.operators import slices

THREAD = ("trace_id", "pid", "tid")


def is_begin() -> Column:
    return F.col("ph").isin("B", "b")


def is_end() -> Column:
    return F.col("ph").isin("E", "e")


def pair_begin_end(events: DataFrame, keep_end_args: bool = False, slice_rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Each begin takes the duration to the end that closes it; ends go.

    An end closes the newest open begin of its thread, whatever its name; one without an open begin is dropped,
    and a begin that nothing closes keeps duration 0. All other events pass unchanged and aren't shuffled.

    The stack is a running sum: +1 for a begin, -1 for an end; where it falls below its least value so far, an
    end has no partner. On one level of the stack, begins and matched ends alternate.

    Threads of more than ``slice_rows`` begins and ends are summed in slices: each slice's sum and least value are
    scanned over the slices before it, and a begin that is the last of its level in a slice meets the first of that level
    in the next slice that has one. So no window takes a whole thread.

    ``keep_end_args`` adds end_args_json, the closing event's arguments (null if none).
    """
    marks = events.where(is_begin() | is_end())
    others = events.where(~(is_begin() | is_end()))
    where = slices.cuts(marks, list(THREAD), [F.col("seq")], slice_rows)
    ended = _ended(marks) if where is None else _ended_in_slices(slices.sliced(marks, where, list(THREAD), [F.col("seq")]))
    if keep_end_args:
        ended = ended.withColumn("end_args_json", F.col("end.args_json"))
        others = others.withColumn("end_args_json", F.lit(None).cast("string"))
    spans = ended.where(is_begin()).withColumn("dur", F.coalesce(F.greatest(F.lit(0), F.col("end.ts") - F.col("ts")), F.lit(0)).cast("bigint"))
    return others.unionByName(spans.select(*others.columns))


def _running(marks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds s, the sum so far, and its least values with (m) and without (pm) the row itself."""
    order = Window.partitionBy(*keys).orderBy("seq")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    summed = marks.withColumn("s", F.sum(F.when(is_begin(), 1).otherwise(-1)).over(so_far))
    return summed.withColumn("m", F.min("s").over(so_far)).withColumn("pm", F.min("s").over(before))


def _matched(running: DataFrame) -> DataFrame:
    """Begins, and ends that close one, with their level of the stack."""
    m, pm = F.least(F.lit(0), "m"), F.least(F.lit(0), F.coalesce("pm", F.lit(0)))
    return running.where(is_begin() | (F.col("s") >= pm)).withColumn("level", F.col("s") - m + F.when(is_begin(), 0).otherwise(1))


def _closing(keys: tuple[str, ...]) -> Column:
    """The end that follows on the same level, with nothing between; null if none does."""
    on_level = Window.partitionBy(*keys, "level").orderBy("seq")
    return F.when(F.lead(is_end()).over(on_level), F.lead(F.struct("ts", "args_json")).over(on_level))


def _ended(marks: DataFrame) -> DataFrame:
    return _matched(_running(marks, THREAD)).withColumn("end", _closing(THREAD))


def _ended_in_slices(marks: DataFrame) -> DataFrame:
    """As ``_ended`` for marks with their slices (_slice)."""
    keys = (*THREAD, "_slice")
    local = _running(marks, keys)
    sums = local.groupBy(*keys).agg(F.sum(F.when(is_begin(), 1).otherwise(-1)).alias("total"), F.min("s").alias("least"))
    earlier = Window.partitionBy(*THREAD).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    sums = sums.withColumn("low", F.coalesce(F.min(F.col("base") + F.col("least")).over(earlier), F.lit(0))).select(*keys, "base", "low")
    based = local.join(sums, list(keys)).withColumn("s", F.col("base") + F.col("s"))
    m, pm = F.least("low", F.col("base") + F.col("m")), F.least("low", F.col("base") + F.col("pm"))
    matched = _matched(based.withColumn("m", m).withColumn("pm", pm)).drop("base", "low")
    ends = F.struct(is_end().alias("is_end"), F.struct("ts", "args_json").alias("end"))
    edges = matched.groupBy(*keys, "level").agg(F.min_by(ends, "seq").alias("first"), F.max("seq").alias("last_seq"))
    following = F.lead("first").over(Window.partitionBy(*THREAD, "level").orderBy("_slice"))
    behind = edges.select(*keys, "level", "last_seq", F.when(following["is_end"], following["end"]).alias("behind"))
    joined = matched.withColumn("end", _closing(keys)).join(behind, [*keys, "level"])
    return joined.withColumn("end", F.when(F.col("seq") == F.col("last_seq"), F.col("behind")).otherwise(F.col("end"))).drop("behind", "last_seq")
