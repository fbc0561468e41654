"""Predicates over events and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelark.operators.normalize import is_counter, is_metadata

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contains_folded(text: Column, pattern: str) -> Column:
    """Whether ``text`` contains ``pattern``, A-Z and a-z alike (no other letters). An empty pattern always does."""
    return F.translate(text, UPPER, LOWER).contains(pattern.translate(str.maketrans(UPPER, LOWER)))


def match_text(pattern: str) -> Column:
    """Name or category contains ``pattern``."""
    return contains_folded(F.col("name"), pattern) | contains_folded(F.col("cat"), pattern)


def search(pattern: str, threads: bool = True, counters: bool = True) -> Column:
    """``match_text``, or any textual argument's value contains ``pattern``; needs args.

    The flags leave out counters or everything else; metadata is always searched.
    """
    text = match_text(pattern) | F.exists("args", lambda a: (a["str"] != "") & contains_folded(a["str"], pattern))
    kind = F.when(is_metadata(), True).when(is_counter(), F.lit(counters)).otherwise(F.lit(threads))
    return text & kind


def overlaps(t0: int | None = None, t1: int | None = None) -> Column:
    """The event's closed interval meets [t0, t1]; a bound of None is open."""
    found = F.lit(True)
    if t0 is not None:
        found = found & (F.col("ts") + F.col("dur") >= t0)
    if t1 is not None:
        found = found & (F.col("ts") <= t1)
    return found


def starts_in(t0: int | None = None, t1: int | None = None) -> Column:
    """The event starts within [t0, t1]; a bound of None is open."""
    found = F.lit(True)
    if t0 is not None:
        found = found & (F.col("ts") >= t0)
    if t1 is not None:
        found = found & (F.col("ts") <= t1)
    return found


def max_depth(n: int) -> Column:
    return F.col("depth") <= n


def on_track(track_events: DataFrame, tracks: DataFrame, name: str) -> DataFrame:
    """Events of the first track, in track order, whose own name is exactly ``name``, in each trace.

    ValueError if no trace has such a track.
    """
    first = tracks.where(F.col("name") == name).groupBy("trace_id").agg(F.min_by("track_id", "track_order").alias("track_id"))
    if first.isEmpty():
        raise ValueError(f"no track is called {name!r}")
    return track_events.join(first, ["trace_id", "track_id"], "left_semi")


def on_tracks_named(track_events: DataFrame, tracks: DataFrame, name: str) -> DataFrame:
    """Events of all tracks whose own name is exactly ``name``; an empty name finds unnamed tracks."""
    return track_events.join(tracks.where(F.col("name") == name).select("trace_id", "track_id"), ["trace_id", "track_id"], "left_semi")


def min_count(groups: DataFrame, n: int = 2) -> DataFrame:
    """Groups with ``count`` of at least ``n``."""
    return groups.where(F.col("count") >= n)


def skipped_count(groups: DataFrame, n: int = 2) -> DataFrame:
    """How many groups ``min_count`` leaves out: kept, skipped."""
    return groups.agg(F.count_if(F.col("count") >= n).alias("kept"), F.count_if(F.col("count") < n).alias("skipped"))


def region_select(nested: DataFrame, tracks: DataFrame, t0: int, t1: int, d0: int = 0, d1: int | None = None) -> DataFrame:
    """Events of ``tracks`` in a box of time and depth: spans that meet [t0, t1] at depths d0 to d1, counters that start in it."""
    chosen = nested.join(tracks.select("trace_id", "track_id"), ["trace_id", "track_id"], "left_semi")
    deep = F.col("depth") >= d0 if d1 is None else F.col("depth").between(d0, d1)
    return chosen.where(F.when(is_counter(), starts_in(t0, t1)).otherwise(overlaps(t0, t1) & deep))


def tracks_with_hits(tracks: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds has_hit: whether the track holds any of ``hits``."""
    held = hits.select("trace_id", "track_id").distinct().withColumn("hit", F.lit(True))
    return tracks.join(held, ["trace_id", "track_id"], "left").withColumn("has_hit", F.coalesce("hit", F.lit(False))).drop("hit")
