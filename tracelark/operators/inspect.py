"""Looking up single events: by track and time, by covered instant, by nearest edge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelark.operators import slices
from tracelark.operators.depth import TRACK, children_of
from tracelark.operators.filters import on_track


def inspect(nested: DataFrame, tracks: DataFrame, name: str, ts: int) -> DataFrame:
    """Events that start exactly at ``ts`` on the first track called ``name``, in order: with self_dur, depth, the
    parent's name and start, args_json, and children (name, ts, dur)."""
    here = on_track(nested, tracks, name)
    chosen = here.where(F.col("ts") == ts)
    above = here.select(*TRACK, F.col("ord").alias("parent_ord"), F.col("name").alias("parent_name"), F.col("ts").alias("parent_ts"))
    below = here.where("parent_ord is not null").groupBy(*TRACK, F.col("parent_ord").alias("ord"))
    below = below.agg(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("at"), "name", "ts", "dur"))).alias("children"))
    joined = chosen.join(above, [*TRACK, "parent_ord"], "left").join(below, [*TRACK, "ord"], "left")
    shown = F.transform(F.coalesce("children", F.expr("array()").cast("array<struct<at:int,name:string,ts:bigint,dur:bigint>>")), lambda c: F.struct(c["name"], c["ts"], c["dur"]))
    return joined.select(*TRACK, "ord", "seq", "name", "cat", "ts", "dur", "self_dur", "depth", "parent_name", "parent_ts", "args_json", shown.alias("children"))


def events_at(events: DataFrame, probes: DataFrame, width: int) -> DataFrame:
    """Probes (probe_id, trace_id, at) with the events that cover them, ``ts <= at < ts + dur``.

    A range join by buckets. Those of events up to ``width`` µs long are so wide; each doubling of the duration has its
    own level of buckets twice as wide. So an event, however long, is in two buckets at most, and a probe in one for
    each level that events have.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("dur") / width))).cast("int")
    wide = F.call_function("shiftleft", F.lit(width).cast("long"), F.col("level"))
    spans = events.where("dur > 0").withColumn("level", level)
    levels = sorted(r["level"] for r in spans.select("level").distinct().collect()) or [0]
    first, last = F.floor(F.col("ts") / wide), F.floor((F.col("ts") + F.col("dur") - 1) / wide)
    spans = spans.withColumn("bucket", F.explode(F.sequence(first, last)))
    probed = probes.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("bucket", F.floor(F.col("at") / wide))
    return spans.join(probed, ["trace_id", "level", "bucket"]).where("ts <= at and at < ts + dur").drop("level", "bucket")


#: Before and after all times.
_NEVER, _EVER = -(1 << 63), (1 << 63) - 1
_STABBED = "trace_id string, at long, events long, first long, last long"


def events_at_totals(events: DataFrame, probes: DataFrame, slice_rows: int = 1 << 18) -> DataFrame:
    """Probes (probe_id, trace_id, at) with how many events cover them, ``ts <= at < ts + dur``, and the least and greatest seq of
    these: probe_id, trace_id, at, events, first, last. Probes that nothing covers are left out.

    ``events_at`` without its pairs, whose number is that of events times probes: the work here grows with events plus
    probes. Time is cut into slices of about ``slice_rows`` different instants. An event's two ends go to their slices; the
    slices that it covers whole are told by at most two blocks of 1, 2, 4, ... slices a doubling, which are reduced before
    they are spread. Equal instants are reduced before they meet, so none makes a slice long.
    """
    spans = events.where("dur > 0").select("trace_id", "seq", "ts", (F.col("ts") + F.col("dur")).alias("end"))
    asked = probes.select("trace_id", "at").where("at is not null").distinct()
    instants = spans.select("trace_id", F.explode(F.array("ts", "end")).alias("at")).unionByName(asked)
    cut = slices.cuts(instants, ["trace_id"], [F.col("at")], slice_rows)
    number = 0 if cut is None else cut.agg(F.max(F.size("cuts")).alias("n")).first()["n"] or 0

    def placed(rows: DataFrame, **slice_of: Column) -> DataFrame:
        if not number:
            return rows.withColumns({name: F.lit(0) for name in slice_of})
        places = cut.select("trace_id", F.transform("cuts", lambda c: c["o0"]).alias("cuts"))
        joined = rows.join(F.broadcast(places), "trace_id", "left")
        return joined.withColumns({name: slices.slices_before("cuts", at, number) for name, at in slice_of.items()}).drop("cuts")

    spans = placed(spans, a=F.col("ts"), b=F.col("end") - 1)
    facts = (F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    never, ever = F.lit(_NEVER).cast("long"), F.lit(_EVER).cast("long")

    def piece(slice_: str, lo: Column, hi: Column) -> Column:
        return F.struct(F.col(slice_).alias("slice"), lo.alias("lo"), hi.alias("hi"))

    ends = F.when(F.col("a") == F.col("b"), F.array(piece("a", F.col("ts"), F.col("end")))).otherwise(F.array(piece("a", F.col("ts"), ever), piece("b", never, F.col("end"))))
    parts = spans.select("trace_id", "seq", F.inline(ends)).groupBy("trace_id", "slice", "lo", "hi").agg(*facts)
    if number:
        parts = parts.unionByName(_covered_slices(spans, number, facts).select("trace_id", "slice", never.alias("lo"), ever.alias("hi"), "n", "low", "high"))
    met = parts.unionByName(placed(asked.withColumnRenamed("at", "lo"), slice=F.col("lo")), allowMissingColumns=True)
    found = met.groupBy("trace_id", "slice").applyInArrow(_stabbed, _STABBED)
    return probes.join(found, ["trace_id", "at"]).select("probe_id", "trace_id", "at", "events", "first", "last")


def _covered_slices(spans: DataFrame, number: int, facts: tuple[Column, ...]) -> DataFrame:
    """What covers whole slices: those strictly between each span's first (a) and last (b), as blocks of 2^level slices."""
    blocks = []
    for level in range(number.bit_length()):
        first = F.shiftright(F.col("a") + (1 << level), level)  # of a + 1, rounded up
        last = F.shiftright("b", level)
        blocks += [
            F.when((first < last) & (first % 2 == 1), F.struct(F.lit(level).alias("level"), first.alias("block"))),
            F.when((first < last) & (last % 2 == 1), F.struct(F.lit(level).alias("level"), (last - 1).alias("block"))),
        ]
    within = spans.where("b - a > 1").select("trace_id", "seq", F.inline(F.array_compact(F.array(*blocks))))
    reduced = within.groupBy("trace_id", "level", "block").agg(*facts)
    low, high = (F.call_function("shiftleft", b, F.col("level")) for b in (F.col("block"), F.col("block") + 1))
    each = reduced.withColumn("slice", F.explode(F.sequence(low, high - 1)))
    return each.groupBy("trace_id", "slice").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _stabbed(table: pa.Table) -> pa.Table:
    """For one slice: its probes (rows without ``n``) with the totals of the spans that cover them.

    A span covers a run of the probes in order. Least and greatest seq of a run are noted at the two runs of a power of two
    that it is made of, and from there handed down to runs of half the length.
    """
    spans, probes = table.filter(pc.is_valid(table["n"])), table.filter(pc.is_null(table["n"]))
    at = np.sort(probes["lo"].to_numpy())
    first, last = (np.searchsorted(at, spans[c].to_numpy()) for c in ("lo", "hi"))
    low, high = (pc.fill_null(spans[c], empty).to_numpy() for c, empty in (("low", _EVER), ("high", _NEVER)))
    met = first < last
    first, last, low, high, n = first[met], last[met], low[met], high[met], spans["n"].to_numpy()[met]
    change = np.zeros(len(at) + 1, np.int64)
    np.add.at(change, first, n)
    np.subtract.at(change, last, n)
    events = np.cumsum(change[:-1])
    least, most = np.full(len(at), _EVER), np.full(len(at), _NEVER)
    level = np.frexp((last - first).astype(float))[1] - 1
    for k in range(int(level.max(initial=-1)), -1, -1):
        half = 1 << k
        least_above, most_above = least.copy(), most.copy()
        np.minimum(least[half:], least_above[:-half], out=least[half:])
        np.maximum(most[half:], most_above[:-half], out=most[half:])
        here = level == k
        for place in (first[here], last[here] - half):
            np.minimum.at(least, place, low[here])
            np.maximum.at(most, place, high[here])
    held = events > 0
    columns = [pa.array(at[held]), pa.array(events[held]), pa.array(least[held], mask=least[held] == _EVER), pa.array(most[held], mask=most[held] == _NEVER)]
    return pa.table([pa.array([table["trace_id"][0].as_py()] * int(held.sum()), pa.string()), *columns], names=["trace_id", "at", "events", "first", "last"])


def nearest_edge(events: DataFrame, probes: DataFrame, tolerance: int) -> DataFrame:
    """Each probe (probe_id, trace_id, at) with the nearest start or end of an event strictly nearer than ``tolerance``.

    Edge and distance are null if none is. Of an earlier and a later edge equally near, the earlier counts. Time is
    cut into buckets of 16 tolerances; an edge goes to each bucket that it is near to, and windows run within buckets.
    """
    width = 16 * tolerance
    edges = events.select("trace_id", F.explode(F.array(F.col("ts"), F.col("ts") + F.col("dur"))).alias("at")).distinct()
    reach = F.sequence(F.floor((F.col("at") - tolerance) / width), F.floor((F.col("at") + tolerance) / width))
    both = edges.select("trace_id", "at", F.col("at").alias("edge"), F.lit(None).cast("long").alias("probe_id"), F.explode(reach).alias("bucket"))
    asked = probes.select("trace_id", "at", F.lit(None).cast("long").alias("edge"), "probe_id", F.floor(F.col("at") / width).alias("bucket"))
    rising, falling = (Window.partitionBy("trace_id", "bucket").orderBy(at) for at in (F.col("at"), F.desc("at")))
    # Both frames grow from row to row; one that shrinks toward its end would be gone through anew for each row.
    before, after = (F.last("edge", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0)) for order in (rising, falling))
    found = both.unionByName(asked).withColumn("before", before).withColumn("after", after).where("probe_id is not null")
    nearer = F.when(F.col("after").isNull() | (F.col("at") - F.col("before") <= F.col("after") - F.col("at")), F.col("before")).otherwise(F.col("after"))
    placed = found.withColumn("edge", nearer).withColumn("distance", F.abs(F.col("at") - F.col("edge")))
    near = F.col("distance") < tolerance
    return placed.select("probe_id", "trace_id", "at", F.when(near, F.col("edge")).alias("edge"), F.when(near, F.col("distance")).alias("distance"))


__all__ = ["children_of", "events_at", "events_at_totals", "inspect", "nearest_edge"]
