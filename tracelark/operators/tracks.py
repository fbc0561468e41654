"""Tracks: discovery, names, order and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelark.operators.args import arg_value, parse_args
from tracelark.operators.filters import LOWER, UPPER
from tracelark.operators.normalize import assign_track, display_name, is_metadata

THREAD = ("trace_id", "pid", "tid")


def leading_integer(text: Column) -> Column:
    """The integer at the start of ``text``, with an optional sign; 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, "^([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0)).cast("int")


def track_names(events: DataFrame) -> DataFrame:
    """name and sort_index of threads, from the last thread_name and thread_sort_index in file order.

    A sort index may be text or a number.
    """
    meta = events.where(is_metadata() & F.col("name").isin("thread_name", "thread_sort_index"))
    args = meta.withColumn("args", parse_args(F.col("args_json")))
    named = F.when(F.col("name") == "thread_name", arg_value(F.col("args"), "name")["str"])
    index = arg_value(F.col("args"), "sort_index")
    sort = F.when(F.col("name") == "thread_sort_index", F.when(index["str"] != "", leading_integer(index["str"])).otherwise(index["num"].cast("int")))
    each = args.select(*THREAD, "seq", named.alias("named"), sort.alias("sort"))
    return each.groupBy(*THREAD).agg(
        F.max_by("named", F.when(F.col("named").isNotNull(), F.col("seq"))).alias("thread_name"),
        F.max_by("sort", F.when(F.col("sort").isNotNull(), F.col("seq"))).alias("sort_index"),
    )


def organize_tracks(events: DataFrame, nested: DataFrame | None = None) -> DataFrame:
    """One row a track: trace_id, track_id, track_type, pid, tid, name, id, sort_index, display_name, event_count,
    max_dur, and max_depth where ``nested`` events are given.

    Threads that only metadata names are tracks too, with no events.
    """
    keyed = assign_track(events)
    counter = F.col("track_type") == "COUNTER"
    own = ~is_metadata()
    # All that a track id stands for is part of the key, so sums and maxima are all that is aggregated.
    tracks = keyed.groupBy(
        "trace_id",
        "track_id",
        "track_type",
        "pid",
        F.when(counter, F.lit(-1)).otherwise(F.col("tid")).alias("tid"),
        F.when(counter, F.col("name")).otherwise(F.lit("")).alias("own_name"),
        F.when(counter, F.col("id")).otherwise(F.lit("")).alias("id"),
    ).agg(F.count_if(own).alias("event_count"), F.coalesce(F.max(F.when(own, F.col("dur"))), F.lit(0)).alias("max_dur"))
    named = tracks.join(track_names(events), [*THREAD], "left")
    name = F.when(counter, F.col("own_name")).otherwise(F.coalesce("thread_name", F.lit("")))
    out = named.select(
        "trace_id",
        "track_id",
        "track_type",
        "pid",
        "tid",
        name.alias("name"),
        "id",
        F.when(counter, 0).otherwise(F.coalesce("sort_index", F.lit(0))).alias("sort_index"),
        "event_count",
        "max_dur",
    )
    out = out.withColumn("display_name", display_name(F.col("track_type"), F.col("name"), F.col("tid"), F.col("id")))
    if nested is None:
        return out
    deepest = nested.groupBy("trace_id", "track_id").agg(F.max("depth").alias("max_depth"))
    return out.join(deepest, ["trace_id", "track_id"], "left").withColumn("max_depth", F.coalesce("max_depth", F.lit(0)))


def order_tracks(tracks: DataFrame) -> DataFrame:
    """Adds track_order, from 1 in each trace: sort index, pid, counters first; counters by name (A-Z as a-z) then id,
    threads by tid. A window over the small table of tracks."""
    counter = F.col("track_type") == "COUNTER"
    order = Window.partitionBy("trace_id").orderBy(
        "sort_index",
        "pid",
        F.when(counter, 0).otherwise(1),
        F.when(counter, F.translate("name", UPPER, LOWER)).otherwise(F.lit("")),
        "id",
        F.when(counter, 0).otherwise(F.col("tid")),
        "track_id",
    )
    return tracks.withColumn("track_order", F.row_number().over(order))


def list_tracks(tracks: DataFrame) -> DataFrame:
    """The report: index (from 0), name, type, pid, tid, events, and max_depth where known."""
    columns = [(F.col("track_order") - 1).alias("index"), F.col("display_name").alias("name"), F.col("track_type").alias("type"), "pid", "tid", F.col("event_count").alias("events")]
    return tracks.select("trace_id", *columns, *(["max_depth"] if "max_depth" in tracks.columns else []))


def attach_track(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """Events with their track's display_name and track_order."""
    return events.join(tracks.select("trace_id", "track_id", "display_name", "track_order"), ["trace_id", "track_id"])


def track_stats(track_events: DataFrame, block: int = 1024) -> DataFrame:
    """Longest duration in each block of ``block`` events in track order: trace_id, track_id, block, max_dur, events."""
    blocks = track_events.withColumn("block", F.floor((F.col("ord") - 1) / block))
    return blocks.groupBy("trace_id", "track_id", "block").agg(F.max("dur").alias("max_dur"), F.count("*").alias("events"))


def hottest_track_window(tracks: DataFrame, n: int = 25) -> DataFrame:
    """The tracks of the ``n`` adjacent ones with the most events, in each trace; the first of equal windows.

    A trace of fewer than ``n`` tracks gives them all.
    """
    ahead = Window.partitionBy("trace_id").orderBy("track_order").rowsBetween(0, n - 1)
    summed = tracks.withColumn("total", F.sum("event_count").over(ahead)).withColumn("width", F.count("*").over(ahead))
    whole = F.when((F.col("width") == n) | (F.col("track_order") == 1), F.struct("total", -F.col("track_order")))
    best = summed.groupBy("trace_id").agg(F.max_by("track_order", whole).alias("first"))
    joined = tracks.join(best, "trace_id")
    return joined.where(F.col("track_order").between(F.col("first"), F.col("first") + n - 1)).drop("first")
