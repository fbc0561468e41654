"""Totals over events."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelark.functions.scalars import nice_interval
from tracelark.operators.filters import min_count
from tracelark.operators.normalize import is_metadata
from tracelark.sources.shared import shared_path


def group_key(by: str) -> Column:
    if by not in ("name", "category"):
        raise ValueError(f"group by name or category, not {by!r}")
    return F.col("name" if by == "name" else "cat")


#: What holds any total of longs.
WIDE = "decimal(38,0)"


def aggregate_events(events: DataFrame, by: str = "name", wide: bool = False) -> DataFrame:
    """key, total_dur (µs) and count over all events, metadata and counters too.

    A total that doesn't fit a long (292,471 years) is an error; ``wide`` gives decimals, which hold any.
    """
    dur = F.col("dur").cast("decimal(19,0)") if wide else F.col("dur")
    total = F.sum(dur).cast(WIDE) if wide else F.sum(dur)
    return events.groupBy(group_key(by).alias("key")).agg(total.alias("total_dur"), F.count("*").alias("count"))


def narrowed(totals: DataFrame) -> DataFrame:
    """A small table of ``wide`` totals with longs in place of the decimals if they all fit; else as it is. Stored, so that it is computed once."""
    path = shared_path(totals.sparkSession, "totals")
    totals.write.parquet(path)
    stored = totals.sparkSession.read.schema(totals.schema).parquet(path)
    decimals = [c for c, kind in stored.dtypes if kind == WIDE]
    fit = reduce(and_, (F.col(c).isNull() | F.col(c).between(-(1 << 63), (1 << 63) - 1) for c in decimals), F.lit(True))
    return stored if not stored.where(~fit).isEmpty() else stored.withColumns({c: F.col(c).cast("long") for c in decimals})


def sorted_groups(groups: DataFrame, sort: str = "duration") -> DataFrame:
    """Largest total duration or count first, then by key."""
    if sort not in ("duration", "count"):
        raise ValueError(f"sort by duration or count, not {sort!r}")
    return groups.orderBy(F.desc("total_dur" if sort == "duration" else "count"), "key")


def aggregate_report(events: DataFrame, by: str = "name", sort: str = "duration", least: int = 2) -> DataFrame:
    """Groups of at least ``least`` events with total_s, count and average_ms, in order."""
    groups = sorted_groups(min_count(aggregate_events(events, by), least), sort)
    return groups.select("key", "total_dur", (F.col("total_dur") / 1e6).alias("total_s"), "count", (F.col("total_dur") / F.col("count") / 1e3).alias("average_ms"))


def summary(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row a trace: event_count, track_count, min_ts, max_ts, duration_ms. Times leave metadata out; 0 without events."""
    real = F.when(~is_metadata(), F.col("ts"))
    end = F.when(~is_metadata(), F.col("ts") + F.col("dur"))
    totals = events.groupBy("trace_id").agg(F.count("*").alias("event_count"), F.coalesce(F.min(real), F.lit(0)).alias("min_ts"), F.coalesce(F.max(end), F.lit(0)).alias("max_ts"))
    counted = tracks.groupBy("trace_id").agg(F.count("*").alias("track_count"))
    return totals.join(counted, "trace_id").select("trace_id", "event_count", "track_count", "min_ts", "max_ts", ((F.col("max_ts") - F.col("min_ts")) / 1e3).alias("duration_ms"))


def diff_traces(baseline: DataFrame, target: DataFrame, by: str = "name", wide: bool = False) -> DataFrame:
    """Totals of two sets of events side by side, with target less baseline; a missing side counts 0. ``wide`` as for ``aggregate_events``."""
    a = aggregate_events(baseline, by, wide).select("key", F.col("total_dur").alias("base_dur"), F.col("count").alias("base_count"))
    b = aggregate_events(target, by, wide).select("key", F.col("total_dur").alias("target_dur"), F.col("count").alias("target_count"))
    both = a.join(b, "key", "full_outer").na.fill(0)
    return both.withColumn("delta_dur", F.col("target_dur") - F.col("base_dur")).withColumn("delta_count", F.col("target_count") - F.col("base_count"))


def sorted_diff(diff: DataFrame, sort: str = "duration") -> DataFrame:
    """Largest growth first, then by key."""
    if sort not in ("duration", "count"):
        raise ValueError(f"sort by duration or count, not {sort!r}")
    return diff.orderBy(F.desc("delta_dur" if sort == "duration" else "delta_count"), "key")


def auto_bin_counts(events: DataFrame, ticks: int = 20) -> DataFrame:
    """Events by start, in bins of a round width for the whole range: bin_start, count. Bins are multiples of the width."""
    span = (F.max("ts") - F.min("ts")).cast("double")
    width = int(events.agg(F.coalesce(nice_interval(span, F.lit(float(max(2, ticks))), F.lit(1.0)), F.lit(1.0)).alias("w")).first()["w"])
    return events.groupBy((F.floor(F.col("ts") / width) * width).alias("bin_start")).agg(F.count("*").alias("count"))


def query_events(track_events: DataFrame, limit: int | None = None) -> DataFrame:
    """In order of start, then track, then order on the track; the first ``limit``. Filter before."""
    ordered = track_events.orderBy("ts", "track_order", "ord")
    return ordered if limit is None else ordered.limit(limit)


def sort_results(events: DataFrame, column: str | None = None, ascending: bool = True) -> DataFrame:
    """By name, category, ts or dur, ties by seq in the same direction; without a column by seq."""
    names = {None: "seq", "name": "name", "category": "cat", "ts": "ts", "dur": "dur"}
    if column not in names:
        raise ValueError(f"sort by name, category, ts or dur, not {column!r}")
    keys = [F.col(names[column]), F.col("seq")]
    return events.orderBy(*(k.asc() if ascending else k.desc() for k in keys))
