"""Counter tracks: series, totals and down-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACK = ("trace_id", "track_id")


def counter_series(counters: DataFrame) -> DataFrame:
    """series of each counter track: its argument keys, bytewise sorted. Takes counter events with track_id and args."""
    keys = counters.select(*TRACK, F.explode(F.transform("args", lambda a: a["key"])).alias("key")).distinct()
    return keys.groupBy(*TRACK).agg(F.sort_array(F.collect_list("key")).alias("series"))


def args_total(args: Column) -> Column:
    return F.aggregate(args, F.lit(0.0), lambda a, x: a + x["num"])


def counter_max_total(counters: DataFrame) -> DataFrame:
    """max_total of each counter track: the largest sum of an event's values, 0 at least."""
    return counters.groupBy(*TRACK).agg(F.greatest(F.lit(0.0), F.max(args_total(F.col("args")))).alias("max_total"))


def counter_totals(counters: DataFrame, series: DataFrame) -> DataFrame:
    """Each counter event's rows to show: trace_id, track_id, seq, label, value.

    One per series, last series first, and a Total where there are several and none is called so. A single series
    without a telling name ('', value, Value or the track's) is called Value.
    """
    joined = counters.join(series, list(TRACK))

    def value(key: Column) -> Column:
        return F.coalesce(F.get(F.filter("args", lambda a: a["key"] == key), F.lit(0))["num"], F.lit(0.0))

    rows = F.transform(F.reverse("series"), lambda key: F.struct(key.alias("label"), value(key).alias("value")))
    only = F.get("series", F.lit(0))
    plain = (F.size("series") == 1) & (only.isin("", "value", "Value") | (only == F.col("name")))
    total = F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["value"])
    named = F.exists("series", lambda key: key.isin("total", "Total"))
    shown = (
        F.when(plain, F.array(F.struct(F.lit("Value").alias("label"), value(only).alias("value"))))
        .when((F.size("series") > 1) & ~named, F.concat(rows, F.array(F.struct(F.lit("Total").alias("label"), total.alias("value")))))
        .otherwise(rows)
    )
    return joined.select(*TRACK, "seq", F.inline(shown))


def downsample_counters(counters: DataFrame, series: DataFrame | None, t0: int, t1: int, cell: int) -> DataFrame:
    """Peaks of each series over cells of ``cell`` µs that meet [t0, t1): trace_id, track_id, cell, start_ts, end_ts, series, peak.

    Within a cell the largest value counts; a cell in which a series has none carries its last value on. The value
    before the first cell is that of the last event before it, and 0 for series which that event lacks. Cells are
    clipped to the track's first and last event. Takes counter events with track_id and args; ``series`` restricts the
    series, all of each track's if None.

    Events are read once, and reduced where they are to a state for each series and cell (its largest and last value),
    with all that comes before the first cell in one, and all after the last. Only these meet by track.
    """
    first_cell, last_cell = t0 // cell, -(-t1 // cell) - 1
    order = F.struct("ts", F.negative("dur").alias("shorter"), "seq")
    place = F.least(F.greatest(F.floor(F.col("ts") / cell), F.lit(first_cell - 1)), F.lit(last_cell + 1)).cast("long")
    each = counters.select(*TRACK, "ts", order.alias("at"), place.alias("cell"), F.explode_outer(F.transform("args", lambda a: F.struct(a["key"].alias("series"), a["num"].alias("num")))).alias("a"))
    facts = (F.max("a.num").alias("top"), F.max_by("a.num", "at").alias("last"), F.max("at").alias("at"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    states = each.groupBy(*TRACK, F.col("a.series").alias("series"), "cell").agg(*facts)
    track = Window.partitionBy(*TRACK)
    spanned = states.withColumn("first_ts", F.min("first_ts").over(track)).withColumn("last_ts", F.max("last_ts").over(track)).withColumn("prior", F.max(F.when(F.col("cell") < first_cell, F.col("at"))).over(track))
    begin = F.greatest(F.lit(first_cell), F.floor(F.col("first_ts") / cell)).cast("long")
    # The last cell is the one that reaches the last event, or the viewport's end.
    end = F.least(F.lit(last_cell), F.greatest(F.ceil(F.col("last_ts") / cell) - 1, F.col("begin"))).cast("long")
    seen = spanned.where((F.lit(t1) > F.col("first_ts")) & (F.lit(t0) < F.col("last_ts"))).withColumn("begin", begin).withColumn("end", end).where("end >= begin and series is not null")
    inside = F.when(F.col("cell").between(F.col("begin"), F.col("end")), F.struct("cell", "top", "last"))
    carried = F.coalesce(F.max(F.when((F.col("cell") < first_cell) & (F.col("at") == F.col("prior")), F.col("last"))), F.lit(0.0))
    lines = seen.groupBy(*TRACK, "series", "first_ts", "last_ts", "begin", "end").agg(F.sort_array(F.collect_list(inside)).alias("inside"), carried.alias("carried"))
    if series is not None:
        lines = lines.join(series.select(*TRACK, F.explode("series").alias("series")), [*TRACK, "series"], "left_semi")
    # Each state holds until the next.
    points = F.concat(F.array(F.struct((F.col("begin") - 1).alias("cell"), F.col("carried").alias("top"), F.col("carried").alias("last"))), "inside")
    until = F.zip_with("points", F.concat(F.slice("points", F.lit(2), F.size("points")), F.array(F.struct((F.col("end") + 1).alias("cell"), F.lit(0.0).alias("top"), F.lit(0.0).alias("last")))), lambda p, q: F.struct(p["cell"].alias("at"), p["top"].alias("top"), p["last"].alias("last"), q["cell"].alias("next")))
    held = lines.withColumn("points", points).select(*TRACK, "series", "first_ts", "last_ts", "begin", F.inline(until))
    cells = held.where(F.col("next") > F.greatest("at", "begin")).withColumn("cell", F.explode(F.sequence(F.greatest("at", "begin"), F.col("next") - 1)))
    peak = F.when(F.col("cell") == F.col("at"), F.col("top")).otherwise(F.col("last"))
    start = F.greatest(F.col("cell") * cell, F.col("first_ts"), F.lit(t0))
    stop = F.least((F.col("cell") + 1) * cell, F.col("last_ts"), F.lit(t1))
    return cells.select(*TRACK, "cell", start.alias("start_ts"), stop.alias("end_ts"), "series", peak.alias("peak")).where("end_ts > start_ts")


def stack_series(peaks: DataFrame) -> DataFrame:
    """Adds low and high: where each series begins and ends in a stacked area, in order of series."""
    order = Window.partitionBy(*TRACK, "cell").orderBy("series")
    high = F.sum("peak").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return peaks.withColumn("high", high).withColumn("low", F.col("high") - F.col("peak"))
