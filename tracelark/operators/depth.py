"""Order, nesting and self time of events on their tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tracelark.operators import slices
from tracelark.sources.shared import shared_path

TRACK = ("trace_id", "track_id")


def track_order_events(events: DataFrame, slice_rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Adds ord, from 1 within the track: by start, longer first, then seq. Takes track events (no metadata).

    A track of more than ``slice_rows`` events is counted in slices.
    """
    place = [F.col("ts"), F.negative("dur"), F.col("seq")]
    cut = slices.cuts(events, list(TRACK), place, slice_rows)
    order = ("ts", F.desc("dur"), "seq")
    if cut is None:
        return events.withColumn("ord", F.row_number().over(Window.partitionBy(*TRACK).orderBy(*order)))
    sliced = slices.earlier(slices.sliced(events, cut, list(TRACK), place), list(TRACK), _before=(F.count("*"), F.sum))
    own = F.row_number().over(Window.partitionBy(*TRACK, "_slice").orderBy(*order))
    return sliced.withColumn("ord", (F.coalesce("_before", F.lit(0)) + own).cast("int")).select(*events.columns, "ord")


def quiescent_segments(ordered: DataFrame, slice_rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Adds end_ts and seg: a track is cut wherever an event starts at or after the end of all before it.

    Tables that may hold tracks of more than ``slice_rows`` events are gone through in slices of so many.
    """
    ended = ordered.withColumn("end_ts", F.col("ts") + F.col("dur"))
    if not slices.may_be_long(ordered, slice_rows):
        order = Window.partitionBy(*TRACK).orderBy("ord")
        open_until = F.max("end_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
        cut = ended.withColumn("cut", F.when(F.col("ts") >= open_until, 1).otherwise(0))
        return cut.withColumn("seg", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")
    order = Window.partitionBy(*TRACK, "_slice").orderBy("ord")
    sliced = ended.withColumn("_slice", F.floor((F.col("ord") - 1) / slice_rows))
    sliced = slices.earlier(sliced, list(TRACK), _until=(F.max("end_ts"), F.max))
    open_until = F.greatest("_until", F.max("end_ts").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    cut = sliced.withColumn("_cut", F.when(F.col("ts") >= open_until, 1).otherwise(0))
    cut = slices.earlier(cut, list(TRACK), _cuts=(F.sum("_cut"), F.sum))
    seg = F.coalesce("_cuts", F.lit(0)) + F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("seg", seg).select(*ended.columns, "seg")


def resolve_parents(segments: DataFrame, fan: int = 64) -> DataFrame:
    """parent_ord of each nested event: the latest earlier one on its track that contains its end.

    A search by joins, for tables in which ``ord`` counts a track's events: ``call_depth`` gives parents and depths in one
    pass. Ends are gathered ``fan`` in a block, the blocks' maxima again, level by level. An event looks for the last end
    that reaches its own among those before it in its block, then among the blocks before that one, and so on up; from
    the level where it finds one it goes down to the event. So each takes a join a level up and one down, however much is
    open at once: the work grows with the events, on a track where nothing ever closes too.
    """
    spark, key = segments.sparkSession, [*TRACK, "block"]
    events = segments.select(*TRACK, (F.col("ord") - 1).cast("long").alias("at"), "end_ts", F.greatest("end_ts", F.col("ts") + 1).alias("sought"))
    deepest = events.agg(F.max("at").alias("at")).first()["at"]
    if deepest is None:
        return segments.sparkSession.createDataFrame([], "trace_id string, track_id string, ord int, parent_ord int")

    def stored(df: DataFrame) -> DataFrame:
        path = shared_path(spark, "parents")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def gathered(nodes: DataFrame) -> DataFrame:
        """Nodes (at, end) as blocks of their ends in order."""
        block = F.floor(F.col("at") / fan).cast("long").alias("block")
        return nodes.groupBy(*TRACK, block).agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias("ends")).select(*key, F.transform("ends", lambda e: e["end"]).alias("ends"))

    def last_before(bound: Column) -> Column:
        """The last place below ``bound`` in the block whose end reaches what is sought."""
        return F.when(bound > 0, F.array_max(F.filter(F.sequence(F.lit(0), bound.cast("int") - 1), lambda j: F.get("ends", j) >= F.col("sought"))))

    levels = [stored(gathered(events.select(*TRACK, "at", F.col("end_ts").alias("end"))))]
    while fan ** len(levels) <= deepest:
        levels.append(gathered(levels[-1].select(*TRACK, F.col("block").alias("at"), F.array_max("ends").alias("end"))))
    rising = events.select(*TRACK, "sought", F.col("at").alias("own"), "at")
    found: list[DataFrame] = []
    for blocks in levels:
        placed = rising.withColumn("block", F.floor(F.col("at") / fan).cast("long")).withColumn("bound", F.col("at") % fan)
        searched = stored(placed.join(blocks, key).select(*TRACK, "sought", "own", F.col("block").alias("at"), last_before(F.col("bound")).alias("place")))
        found.append(searched.where("place is not null").select(*TRACK, "sought", "own", (F.col("at") * fan + F.col("place")).alias("at")))
        rising = searched.where("place is null").drop("place")
    falling = found[-1]
    for blocks, here in zip(reversed(levels[:-1]), reversed(found[:-1]), strict=True):
        below = falling.withColumnRenamed("at", "block").join(blocks, key)
        falling = below.select(*TRACK, "sought", "own", (F.col("block") * fan + last_before(F.size("ends"))).alias("at")).unionByName(here)
    return falling.select(*TRACK, (F.col("own") + 1).cast("int").alias("ord"), (F.col("at") + 1).cast("int").alias("parent_ord"))


def call_depth(track_events: DataFrame, slice_us: int | None = None, slice_rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Adds ord, end_ts, depth and parent_ord (null at the top) to track events (no metadata).

    One shuffle by track, one sort, and one pass over the sorted rows with the stack of open events: memory is the
    stack's, however long a track is. An event that its predecessor only overlaps falls back to a higher level.
    Counter events are never nested. Columns that nobody needs should be dropped before: all go through the shuffle.

    A track of more than ``slice_rows`` events is dealt to tasks in slices of about so many, cut where a sample says (with
    ``slice_us``, every track in slices of so many microseconds). The result is the same. A first pass over the times
    alone finds what each slice closes and leaves open, which is composed in order.
    """
    base = track_events.drop("ord", "end_ts", "depth", "parent_ord")
    added = [StructField("ord", IntegerType()), StructField("end_ts", LongType()), StructField("depth", IntegerType()), StructField("parent_ord", IntegerType())]
    schema = StructType([*base.schema.fields, *added])
    order = ("ts", F.desc("dur"), "seq")
    place = [F.col("ts"), F.negative("dur"), F.col("seq")]
    cut = None if slice_us else slices.cuts(base, list(TRACK), place, slice_rows)
    nest = _nest(base.columns, [f.name for f in schema.fields], bool(slice_us) or cut is not None)
    if not slice_us and cut is None:
        return base.repartition(*TRACK).sortWithinPartitions(*TRACK, *order).mapInArrow(nest, schema)
    sliced = base.withColumn("_slice", F.floor(F.col("ts") / slice_us)) if slice_us else slices.sliced(base, cut, list(TRACK), place).withColumn("_slice", F.col("_slice").cast("long"))
    times = sliced.select(*TRACK, "_slice", "track_type", "ts", "dur", "seq").repartition(*TRACK, "_slice").sortWithinPartitions(*TRACK, "_slice", *order)
    left = times.mapInArrow(_left_open, _LEFT_OPEN).repartition(*TRACK).sortWithinPartitions(*TRACK, "_slice")
    both = sliced.unionByName(left.mapInArrow(_carried, _CARRIED), allowMissingColumns=True)
    first = F.col("_carry").isNull()
    return both.repartition(*TRACK, "_slice").sortWithinPartitions(*TRACK, "_slice", first, *order).mapInArrow(nest, schema)


def _nest(kept: list[str], names: list[str], with_slices: bool):
    """The pass over sorted rows. A slice's first row may be what is open before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, open_ = None, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = ["trace_id", "track_id", *(["_slice"] if with_slices else [])]
            changed = np.zeros(batch.num_rows, bool)
            for name in keys:
                column = pc.fill_null(batch[name], 0 if name == "_slice" else "")
                changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            first = tuple(batch[name][0].as_py() for name in keys)
            if first != key:
                at, open_ = 0, []
            carries = np.flatnonzero(pc.is_valid(batch["_carry"]).to_numpy(zero_copy_only=False)).tolist() if with_slices else []
            before = {i: batch["_carry"][i].as_py() for i in carries}
            rows = batch.select(kept)
            if before:
                events = np.ones(batch.num_rows, bool)
                events[carries] = False
                rows = rows.filter(pa.array(events))
            tracks = np.cumsum(changed)
            starts = {0: (at, open_)} | {int(tracks[i]): (c["before"], list(zip(c["ords"], c["ends"], strict=True))) for i, c in before.items()}
            tracks = np.delete(tracks, carries) if before else tracks
            ts = rows["ts"].to_numpy(zero_copy_only=False)
            end = ts + rows["dur"].to_numpy(zero_copy_only=False)
            opens = pc.not_equal(rows["track_type"], "COUNTER").to_numpy(zero_copy_only=False)
            ords, depths, parents, at, open_ = nesting(tracks, ts, end, opens, starts, int(np.count_nonzero(changed)))
            key = tuple(batch[name][batch.num_rows - 1].as_py() for name in keys)
            new = [pa.array(ords.astype(np.int32)), pa.array(end), pa.array(depths.astype(np.int32)), pa.array(parents.astype(np.int32), mask=parents < 0)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *new], names)

    return run


def nesting(tracks: np.ndarray, ts: np.ndarray, end: np.ndarray, opens: np.ndarray, starts: dict[int, tuple[int, list[tuple[int, int]]]], last: int) -> tuple:
    """Places, depths and parents (-1 for none) of events sorted by ``tracks`` (numbers) and in order; and what is left open.

    ``starts`` has, by track, how many events came before and which are open, from the bottom. Where nothing but the nested
    is open together, the depth is the number begun less the number ended, and the parent the latest event one level up.
    Stretches in which events only overlap go through a stack.
    """
    open_at = [(t, o, e) for t, (_, stack) in sorted(starts.items()) for o, e in stack]
    n = len(open_at)
    track = np.concatenate([np.array([t for t, _, _ in open_at], np.int64), tracks])
    ends = np.concatenate([np.array([e for _, _, e in open_at], np.int64), end])
    order = np.argsort(track, kind="stable")
    track, ends = track[order], ends[order]
    real = order >= n
    begin = np.full(len(order), np.iinfo(np.int64).min)
    begin[real] = ts
    can_open = np.ones(len(order), bool)
    can_open[real] = opens & (end > ts)
    first = np.searchsorted(track, np.arange(last + 1))
    before = np.array([starts.get(t, (0, []))[0] for t in range(last + 1)], np.int64)
    real_first = np.searchsorted(tracks, np.arange(last + 1))
    places = before[tracks] + np.arange(len(tracks)) - real_first[tracks] + 1
    own = np.zeros(len(order), np.int64)
    own[real] = places
    own[~real] = [o for _, o, _ in open_at]
    # Times as their ranks, so that track and time fit one number.
    _, ranks = np.unique(np.concatenate([begin, ends]), return_inverse=True)
    wide = len(ranks) + 1
    begins, ended = track * wide + ranks[: len(order)], track * wide + ranks[len(order) :]
    closing = np.sort(ended[can_open])
    done = np.searchsorted(closing, begins, "right") - np.searchsorted(closing, track * wide)
    begun = np.cumsum(can_open) - can_open
    depth = begun - begun[first[track]] - done
    stacked = np.flatnonzero(~real)
    depth[stacked] = stacked - first[track[stacked]]  # what is open at the start is nested already
    levels = track * (len(order) + 1) + np.maximum(depth, 0)
    openers = np.flatnonzero(can_open)
    by_level = openers[np.argsort(levels[openers], kind="stable")]
    sought = np.searchsorted(levels[by_level] * (len(order) + 1) + by_level, (levels - 1) * (len(order) + 1) + np.arange(len(order))) - 1
    parent = np.where(depth > 0, by_level[np.maximum(sought, 0)] if len(by_level) else -1, -1)
    nested = (depth == 0) | ((ends[parent] >= ends) & (ends[parent] > begin) & (track[parent] == track) & (depth[parent] == depth - 1))
    nested |= ~real
    if not nested.all() or (depth < 0).any():
        segment = _segments(track, begin, np.where(can_open, ended, -1), begins)
        for s in np.unique(segment[~nested | (depth < 0)]).tolist():
            low, high = np.searchsorted(segment, [s, s + 1])
            _by_stack(low, high, begin, ends, can_open, real, depth, parent)
    rows = np.flatnonzero(real)
    parents = np.where(parent[rows] >= 0, own[parent[rows]], -1)
    # What is open at the end: the last event that can be, and all above it.
    at, left = starts.get(last, (0, []))
    tail = len(order) - 1
    if tail >= 0 and track[tail] == last and real[tail]:
        at, left, i = int(own[tail]), [], tail if can_open[tail] else int(parent[tail])
        while i >= 0:
            left.append((int(own[i]), int(ends[i])))
            i = int(parent[i])
        left.reverse()
    return places, depth[rows], parents, at, left


def _segments(track: np.ndarray, begin: np.ndarray, ended: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Numbers of the stretches at whose starts nothing is open. Ends and begins are by track and rank."""
    until = np.maximum.accumulate(ended)
    cut = np.ones(len(track), bool)
    cut[1:] = (track[1:] != track[:-1]) | (begins[1:] >= until[:-1])
    return np.cumsum(cut)


def _by_stack(low: int, high: int, begin: np.ndarray, ends: np.ndarray, can_open: np.ndarray, real: np.ndarray, depth: np.ndarray, parent: np.ndarray) -> None:
    stack: list[tuple[int, int]] = []
    depths, parents = [], []
    columns = (a[low:high].tolist() for a in (begin, ends, can_open, real))
    for i, (ts, end, opens, event) in enumerate(zip(*columns, strict=True), low):
        if event:
            while stack and not (stack[-1][1] >= end and stack[-1][1] > ts):
                stack.pop()
        depths.append(len(stack))
        parents.append(stack[-1][0] if stack else -1)
        if opens:
            stack.append((i, end))
    depth[low:high], parent[low:high] = depths, parents


_LEFT_OPEN = "trace_id string, track_id string, _slice long, events int, last_end long, last_ts long, ords array<int>, ends array<long>"
_CARRIED = "trace_id string, track_id string, _slice long, _carry struct<before: int, ords: array<int>, ends: array<long>>"


def _left_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice of a track, in order: the number of events, their latest end and start, and what they leave open.

    An event stays open if no later one of its slice ends after it or starts at or after its end. All slices of a batch are
    told at once; what goes on in the next batch is held.
    """
    fields = ("trace_id", "track_id", "_slice")
    types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
    names = (*fields, "events", "last_end", "last_ts", "ords", "ends")
    held: tuple | None = None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        found = _open_at_ends(batch, fields)
        if held and held[:3] == found[0][:3]:
            found[0] = _followed(held, found[0])
        elif held:
            found.insert(0, held)
        held = found.pop()
        yield rows(found)
    if held:
        yield rows([held])


def _open_at_ends(batch: pa.RecordBatch, fields: tuple[str, ...]) -> list[tuple]:
    """Rows of ``_left_open`` for the slices, or parts of them, in one batch."""
    changed = np.ones(batch.num_rows, bool)
    changed[1:] = False
    for name in fields:
        column = pc.fill_null(batch[name], 0 if name == "_slice" else "")
        changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(changed)
    last = np.append(first[1:], batch.num_rows) - 1
    slice_ = np.cumsum(changed) - 1
    ts = batch["ts"].to_numpy(zero_copy_only=False)
    end = ts + batch["dur"].to_numpy(zero_copy_only=False)
    # Ends as their ranks, those of earlier slices above all of later ones, so that one scan from the back does for all.
    ranks = np.unique(end, return_inverse=True)[1] + (slice_[-1] - slice_) * (len(end) + 1)
    latest = np.maximum.accumulate(ranks[::-1])[::-1]
    stays = np.ones(len(end), bool)
    stays[:-1] = (ranks[:-1] >= latest[1:]) & (end[:-1] > ts[last][slice_[:-1]])
    stays[last] = True
    stays &= pc.fill_null(pc.not_equal(batch["track_type"], "COUNTER"), True).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(stays)
    bounds = np.searchsorted(at, np.append(first, len(end))).tolist()
    ords, ends = (at - first[slice_[at]] + 1).tolist(), end[at].tolist()
    keys = [batch[name].take(pa.array(first)).to_pylist() for name in fields]
    facts = zip(*keys, (last - first + 1).tolist(), np.maximum.reduceat(end, first).tolist(), ts[last].tolist(), bounds[:-1], bounds[1:], strict=True)
    return [(*fact, ords[a:b], ends[a:b]) for *fact, a, b in facts]


def _followed(before: tuple, after: tuple) -> tuple:
    """One row of ``_left_open`` for two parts of a slice."""
    *key, events, last_end, _, ords, ends = before
    _, _, _, more, then_end, then_ts, then_ords, then_ends = after
    kept = [(o, e) for o, e in zip(ords, ends, strict=True) if e >= then_end and e > then_ts]
    return (*key, events + more, max(last_end, then_end), then_ts, [o for o, _ in kept] + [events + o for o in then_ords], [e for _, e in kept] + then_ends)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is open before each slice, from what slices leave open: ends fall from the bottom of a stack to its top, so
    a slice closes just those events below its own that end before its latest end or by its latest start."""
    track, before = None, 0
    open_: list[tuple[int, int]] = []
    carry = pa.struct([("before", pa.int32()), ("ords", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64()))])
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if (row["trace_id"], row["track_id"]) != track:
                track, before, open_ = (row["trace_id"], row["track_id"]), 0, []
            found.append({"before": before, "ords": [o for o, _ in open_], "ends": [e for _, e in open_]})
            open_ = [(o, e) for o, e in open_ if e >= row["last_end"] and e > row["last_ts"]]
            open_ += [(before + o, e) for o, e in zip(row["ords"], row["ends"], strict=True)]
            before += row["events"]
        names = ["trace_id", "track_id", "_slice"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, carry)], [*names, "_carry"])


def self_time(nested: DataFrame) -> DataFrame:
    """Adds self_dur: duration less that of direct children. Below 0 where children overlap."""
    spent = nested.where("parent_ord is not null").groupBy(*TRACK, F.col("parent_ord").alias("ord")).agg(F.sum("dur").alias("spent"))
    joined = nested.join(spent, [*TRACK, "ord"], "left")
    return joined.withColumn("self_dur", F.col("dur") - F.coalesce("spent", F.lit(0))).drop("spent")


def children_of(nested: DataFrame) -> DataFrame:
    """Pairs of an event and its direct children: trace_id, track_id, parent_ord, parent_name, ord, name, dur."""
    parent = nested.select(*TRACK, F.col("ord").alias("parent_ord"), F.col("name").alias("parent_name"))
    child = nested.where("parent_ord is not null").select(*TRACK, "parent_ord", "ord", "name", "dur")
    return child.join(parent, [*TRACK, "parent_ord"])
