"""Duration histograms: two passes, of which the first only brings four numbers to the driver."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelark.functions.scalars import bar_chars

BINS = 20


def bin_edges(low: int, high: int) -> tuple[list[int], bool]:
    """Rising edges of the bins for durations from ``low`` to ``high`` (both above 0), and whether they are logarithmic.

    Twenty bins, or one for each value of a narrow range; logarithmic if the range is wide and spans more than two
    powers of ten.
    """
    if high - low < BINS:
        return list(range(low, high + 2)), False
    log = high / low > 100.0
    start, power = math.log10(low), (math.log10(high) - math.log10(low)) / BINS
    raw = [math.floor(10.0 ** (start + j * power) + 0.5) if log else low + (high - low) * j // BINS for j in range(BINS)]
    return list(accumulate([*raw, high + 1], lambda last, edge: max(last + 1, edge))), log


def duration_histogram(events: DataFrame) -> DataFrame:
    """bucket (from 0), min_dur, max_dur, count, is_log: durations of 0 and less in a bucket of their own, if any,
    then the bins, empty ones too. No events give no buckets."""
    spark = events.sparkSession
    seen = F.when(F.col("dur") > 0, F.col("dur"))
    facts = events.agg(F.min(seen).alias("low"), F.max(seen).alias("high"), F.count_if(F.col("dur") <= 0).alias("zero")).first()
    buckets = [(0, 0, 0, False)] if facts["zero"] else []
    edges, log = [], False
    if facts["low"] is not None:
        edges, log = bin_edges(facts["low"], facts["high"])
        buckets += [(len(buckets) + j, a, b - 1, log) for j, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    if not buckets:
        return spark.createDataFrame([], "bucket int, min_dur long, max_dur long, count long, is_log boolean")
    fields, kinds = ("bucket", "min_dur", "max_dur", "is_log"), ("int", "long", "long", "boolean")
    rows = (F.struct(*(F.lit(v).cast(k).alias(f) for f, k, v in zip(fields, kinds, b, strict=True))) for b in buckets)
    shape = spark.range(1).select(F.inline(F.array(*rows)))
    first, place = (1 if facts["zero"] else 0), F
    for j, edge in reversed(list(enumerate(edges[:-1]))):
        place = place.when(F.col("dur") >= edge, first + j)
    place = F.lit(0) if place is F else place.otherwise(0)
    counts = events.groupBy(place.alias("bucket")).agg(F.count("*").alias("count"))
    return shape.join(counts, "bucket", "left").select("bucket", "min_dur", "max_dur", F.coalesce("count", F.lit(0)).alias("count"), "is_log")


def histogram_report(histogram: DataFrame) -> DataFrame:
    """Adds percent, bar (0 to 20) and scale_label.

    The label compares the last bucket's width with the first's, so a zero bucket makes any wider last one count as
    logarithmic; is_log is what the bins really are.
    """
    buckets = histogram.agg(
        F.sum("count").alias("total"),
        F.min_by(F.col("max_dur") - F.col("min_dur"), "bucket").alias("first"),
        F.max_by(F.col("max_dur") - F.col("min_dur"), "bucket").alias("last"),
        F.max(F.col("max_dur") > 0).alias("real"),
    )
    label = F.when(F.col("real") & (F.col("last") > F.col("first") * 2), "logarithmic").otherwise("linear")
    joined = histogram.join(F.broadcast(buckets))  # a single row
    percent = F.when(F.col("total") > 0, F.col("count") / F.col("total") * 100).otherwise(F.lit(0.0))
    return joined.select("bucket", "min_dur", "max_dur", "count", percent.alias("percent"), bar_chars(percent).alias("bar"), label.alias("scale_label"), "is_log")


def bucket_filter(events: DataFrame, histogram: DataFrame, bucket: int | None) -> DataFrame:
    """Events whose duration lies in that bucket; all with None."""
    if bucket is None:
        return events
    # At most one row, joined without a shuffle of the events.
    chosen = histogram.where(F.col("bucket") == bucket).select("min_dur", "max_dur")
    return events.join(F.broadcast(chosen), F.col("dur").between(F.col("min_dur"), F.col("max_dur")), "left_semi")
