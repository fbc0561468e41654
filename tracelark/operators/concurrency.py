"""How many threads are busy, and with what, over equal buckets of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelark.functions.scalars import bar_chars


def trace_bounds(events: DataFrame) -> DataFrame:
    """lo and hi of each trace: first start and last end, without metadata."""
    real = events.where("ph <> 'M'")
    return real.groupBy("trace_id").agg(F.min("ts").alias("lo"), F.max(F.col("ts") + F.col("dur")).alias("hi"))


def bucket_overlap(spans: DataFrame, bounds: DataFrame, n: int = 16) -> DataFrame:
    """Each span's overlap (µs, above 0) with each of the ``n`` equal buckets of its trace that it meets.

    Spans are exploded over the buckets they cover, so nothing is compared that can't overlap.
    """
    placed = spans.join(bounds, "trace_id").where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / n
    sized = placed.withColumn("width", width).withColumn("from_lo", F.col("ts") - F.col("lo"))

    def bucket(at):
        return F.greatest(F.least(F.floor(at / F.col("width")), F.lit(n - 1)), F.lit(0)).cast("int")

    first, last = bucket(F.col("from_lo")), bucket(F.col("from_lo") + F.col("dur"))
    each = sized.withColumn("bucket", F.explode(F.sequence(first, last)))
    start = F.col("lo") + F.col("bucket") * F.col("width")
    overlap = F.least(F.col("ts") + F.col("dur"), start + F.col("width")) - F.greatest(F.col("ts").cast("double"), start)
    return each.withColumn("overlap", overlap).where("overlap > 0").drop("from_lo")


def dominant_events(overlaps: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` names with the most overlapped time in each bucket: trace_id, bucket, rank, name, overlap. Ties by name."""
    order = Window.partitionBy("trace_id", "bucket").orderBy(F.desc("overlap"), "name")
    total = overlaps.groupBy("trace_id", "bucket", "name").agg(F.sum("overlap").alias("overlap"))
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def concurrency(nested: DataFrame, tracks: DataFrame, bounds: DataFrame, n: int = 16, k: int = 3) -> DataFrame:
    """One row a trace and bucket: start_ts, end_ts, concurrency (mean number of top-level thread spans), percent of
    the trace's thread tracks (above 100 where spans of a thread overlap), bar, and the dominant names.

    A trace without extent has ``n`` rows of zeros.
    """
    spans = nested.where("depth = 0 and track_type = 'THREAD'")
    overlaps = bucket_overlap(spans, bounds, n)
    # Both start from one small table of totals, so that spans are nested and spread once.
    totals = overlaps.groupBy("trace_id", "bucket", "width", "name").agg(F.sum("overlap").alias("overlap"))
    busy = totals.groupBy("trace_id", "bucket").agg(F.sum(F.col("overlap") / F.col("width")).alias("concurrency"))
    names = dominant_events(totals, k).groupBy("trace_id", "bucket")
    dominant = names.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("dominant"))
    threads = tracks.groupBy("trace_id").agg(F.count_if(F.col("track_type") == "THREAD").alias("threads"))
    spine = bounds.join(threads, "trace_id").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    joined = spine.join(busy, ["trace_id", "bucket"], "left").join(dominant, ["trace_id", "bucket"], "left")
    width = (F.col("hi") - F.col("lo")) / n
    value = F.coalesce("concurrency", F.lit(0.0))
    percent = F.when(F.col("threads") > 0, value / F.col("threads") * 100).otherwise(F.lit(0.0))
    return joined.select(
        "trace_id",
        "bucket",
        (F.col("lo") + F.col("bucket") * width).alias("start_ts"),
        (F.col("lo") + (F.col("bucket") + 1) * width).alias("end_ts"),
        value.alias("concurrency"),
        percent.alias("percent"),
        bar_chars(percent).alias("bar"),
        F.coalesce("dominant", F.array().cast("array<string>")).alias("dominant"),
    )


def heatmap(nested: DataFrame, bounds: DataFrame, n: int = 16) -> DataFrame:
    """The longest event of each track and bucket by start: trace_id, track_id, bucket, seq, name, dur, hits.

    Threads by top-level events, counters by all; starts outside the bounds fall in the first or last bucket; the
    first in track order wins a tie. Idle buckets have no row.
    """
    placed = nested.where("track_type = 'COUNTER' or depth = 0").join(bounds, "trace_id").where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / n
    bucket = F.greatest(F.least(F.floor((F.col("ts") - F.col("lo")) / width), F.lit(n - 1)), F.lit(0)).cast("int")
    best = F.max_by(F.struct("seq", "name", "dur"), F.struct("dur", -F.col("ord"))).alias("best")
    cells = placed.groupBy("trace_id", "track_id", bucket.alias("bucket")).agg(best, F.count("*").alias("hits"))
    return cells.select("trace_id", "track_id", "bucket", "best.*", "hits")


def coalesce_runs(cells: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Neighbouring cells (``at`` one apart) of equal ``value`` as one run: key, first, last, value."""
    order = Window.partitionBy(*key).orderBy(at)
    same = F.lag(value).over(order).eqNullSafe(F.col(value)) & (F.lag(at).over(order) == F.col(at) - 1)
    marked = cells.withColumn("run", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("run").over(order))
    return marked.groupBy(*key, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.first(value).alias(value)).drop("run")
