"""Level of detail for timelines: large events whole, small ones merged by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelark.operators import slices
from tracelark.sources.stored import read_events

TRACK = ("trace_id", "track_id")


def stored_timeline(spark: SparkSession, path: str, t0: int, t1: int, cell: int, always: Column | None = None) -> DataFrame:
    """``downsample_timeline`` of nested events that ``write_events`` has stored.

    The store's map says which files hold threads' events that meet the cells; no other is opened, so what is read goes
    with the window, not with the trace.
    """
    first = t0 // cell * cell
    last = first + -(-(t1 - first) // cell) * cell
    return downsample_timeline(read_events(spark, path, min(first, t0), last), t0, t1, cell, always)


def downsample_timeline(nested: DataFrame, t0: int, t1: int, cell: int, always: Column | None = None, slice_cells: int = 64, slice_rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Blocks of thread events over cells of ``cell`` µs that meet [t0, t1).

    Events of at least a cell are blocks of their own, and so are those that began before the first cell and reach
    into the range, and those that ``always`` keeps. Smaller ones of the same depth and cell are one block, shown
    by the longest (the first of equals) with a count. A small event is left out if an earlier kept event of its
    depth started in its cell or covers the cell's end.

    Tables that may hold more than ``slice_rows`` events of a track and depth are gone through in slices of ``slice_cells`` cells.

    Returns trace_id, track_id, depth, start_ts, end_ts, count, seq (the shown event), name.
    """
    first = t0 // cell * cell
    last = first + -(-(t1 - first) // cell) * cell
    starts = F.col("ts").between(first, last - 1)
    reaches = (F.col("ts") < first) & (F.col("ts") + F.col("dur") > t0)
    seen = nested.where((F.col("track_type") == "THREAD") & (starts | reaches))
    spanning = F.col("ts") < first
    kept = spanning | (F.col("dur") >= cell)
    if always is not None:
        kept = kept | F.coalesce(always, F.lit(False))
    marked = seen.withColumn("cell", F.when(spanning, F.lit(None)).otherwise(F.floor(F.col("ts") / cell)).cast("long")).withColumn("kept", kept)
    kept_end = F.max(F.when(F.col("kept"), F.col("ts") + F.col("dur")))
    keys = [*TRACK, "depth"]
    if not slices.may_be_long(nested, slice_rows):
        before = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        covered = kept_end.over(before)
    else:
        sliced = marked.withColumn("_slice", F.floor((F.greatest("ts", F.lit(first - 1)) - first) / (cell * slice_cells)))
        marked = slices.earlier(sliced, keys, _covered=(kept_end, F.max))
        before = Window.partitionBy(*keys, "_slice").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        covered = F.greatest("_covered", kept_end.over(before))
    taken = F.max(F.when(F.col("kept"), F.col("cell"))).over(before)
    flagged = marked.withColumn("covered", covered).withColumn("taken", taken)
    # An event that starts in the same cell blocks it; one kept earlier blocks cells up to its end.
    earlier = F.col("covered") >= (F.col("cell") + 1) * cell
    small = flagged.where(~F.col("kept") & ~(F.coalesce(earlier, F.lit(False)) | F.coalesce(F.col("taken") == F.col("cell"), F.lit(False))))
    shown = F.max_by(F.struct("seq", "name"), F.struct("dur", -F.col("ord"))).alias("shown")
    merged = small.groupBy(*TRACK, "depth", "cell").agg(F.count("*").alias("count"), shown)
    blocks = merged.select(*TRACK, "depth", (F.col("cell") * cell).alias("start_ts"), ((F.col("cell") + 1) * cell).alias("end_ts"), "count", F.col("shown.seq").alias("seq"), F.col("shown.name").alias("name"))
    large = flagged.where("kept").select(*TRACK, "depth", F.col("ts").alias("start_ts"), F.greatest(F.col("ts") + F.col("dur"), F.col("ts") + cell).alias("end_ts"), F.lit(1).cast("long").alias("count"), "seq", "name")
    return large.unionByName(blocks)
