from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.helpers import event, frame, nested, rows
from tracelark.operators import aggregates, args, concurrency, counters, depth, filters, histogram, inspect, normalize, pairing, slices, timeline, tracks
from tracelark.plans import catalog, sql


@pytest.mark.parametrize(
    ("spans", "depths", "selves"),
    [
        ([(0, 100), (10, 40), (10, 10), (60, 30), (110, 10)], [0, 1, 2, 1, 0], [30, 30, 10, 30, 10]),
        ([(0, 100), (10, 40), (50, 50)], [0, 1, 1], [10, 40, 50]),
        ([(0, 100), (0, 100)], [0, 1], [0, 100]),
        ([(0, 100), (10, 100), (105, 15)], [0, 0, 0], [100, 100, 15]),
    ],
)
def test_depth_and_self_time(spark, spans, depths, selves):
    out = nested(frame(spark, [event(i, ts=a, dur=b) for i, (a, b) in enumerate(spans)]))
    assert rows(out, "ord", "depth", "self_dur") == [(i + 1, d, s) for i, (d, s) in enumerate(zip(depths, selves, strict=True))]


def stack_model(spans):
    """Parents and depths by a plain scan: the latest earlier event that contains mine."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], -spans[i][1], i))
    out, depths = {}, {}
    for k, i in enumerate(order):
        ts, end = spans[i][0], spans[i][0] + spans[i][1]
        parent = next((p for p in reversed(range(k)) if sum(spans[order[p]]) >= end and sum(spans[order[p]]) > ts), None)
        depths[k] = 0 if parent is None else depths[parent] + 1
        out[i] = (None if parent is None else parent + 1, depths[k])
    return out


@pytest.mark.parametrize(("batch", "cut"), [(3, {}), (10_000, {}), (3, {"slice_us": 7}), (10_000, {"slice_us": 1}), (10_000, {"slice_us": 100}), (3, {"slice_rows": 4}), (10_000, {"slice_rows": 7})])
def test_depth_equals_a_scan_on_random_traces(spark, batch, cut):
    rng = random.Random(3)
    traces = {t: [(rng.randrange(30), rng.choice([0, 1, 3, 8, 15])) for _ in range(rng.randrange(1, 14))] for t in range(60)}
    events = frame(spark, [event(i, ts=a, dur=b, tid=t) for t, spans in traces.items() for i, (a, b) in enumerate(spans)])
    on_tracks = normalize.assign_track(events)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    out = depth.call_depth(on_tracks, **cut).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r["tid"], r["seq"]): (r["parent_ord"], r["depth"]) for r in out}
    parents = depth.resolve_parents(depth.quiescent_segments(depth.track_order_events(on_tracks)))
    assert rows(parents, "track_id", "ord", "parent_ord") == sorted((r["track_id"], r["ord"], r["parent_ord"]) for r in out if r["parent_ord"])
    assert got == {(t, i): x for t, spans in traces.items() for i, x in stack_model(spans).items()}
    assert len(out) == len(got)


def test_nesting_of_batches_equals_a_stack():
    """Nested and overlapping spans of a few tracks, in batches of any size, with what is open carried between them."""
    rng = random.Random(12)
    for _ in range(300):
        events = []
        for track in range(rng.randrange(1, 4)):
            spans = [(rng.randrange(40), rng.choice([0, 0, 1, 2, 5, 9, 20, 40])) for _ in range(rng.randrange(1, 30))]
            if rng.random() < 0.5:  # only nested ones
                spans = sorted(spans, key=lambda s: (s[0], -s[1]))
                spans = [s for i, s in enumerate(spans) if not any(a < s[0] < a + d < s[0] + s[1] for a, d in spans[:i])]
            events += [(track, a, a + d, rng.random() < 0.9) for a, d in sorted(spans, key=lambda s: (s[0], -s[1]))]
        want, stack, now, at = [], [], None, 0
        for track, ts, end, opens in events:
            if track != now:
                now, stack, at = track, [], 0
            at += 1
            while stack and not (stack[-1][1] >= end and stack[-1][1] > ts):
                stack.pop()
            want.append((at, len(stack), stack[-1][0] if stack else -1))
            if opens:
                stack.append((at, end))
        got, size, now, at, open_ = [], rng.choice([1, 2, 5, 1000]), None, 0, []
        for i in range(0, len(events), size):
            few = events[i : i + size]
            tracks = np.cumsum([0] + [a[0] != b[0] for a, b in zip(few, few[1:])])
            if few[0][0] != now:
                at, open_ = 0, []
            ts, end, opens = (np.array([e[k] for e in few]) for k in (1, 2, 3))
            places, depths, parents, at, open_ = depth.nesting(tracks, ts, end, opens, {0: (at, open_)}, int(tracks[-1]))
            now = few[-1][0]
            got += list(zip(places.tolist(), depths.tolist(), parents.tolist()))
        assert got == want, events


def test_one_long_track_is_cut_by_a_sample(spark):
    """Without a width: the cuts follow the rows, and slices hold about as many."""
    rng = random.Random(1)
    spans = [(int(rng.expovariate(1 / 50_000)), rng.randrange(200)) for _ in range(6000)]
    on_tracks = normalize.assign_track(frame(spark, [event(i, ts=a, dur=b) for i, (a, b) in enumerate(spans)] + [event(9000, tid=2)]))
    order = [F.col("ts"), F.negative("dur"), F.col("seq")]
    where = slices.cuts(on_tracks, ["trace_id", "track_id"], order, 640)
    sizes = [r["count"] for r in slices.sliced(on_tracks, where, ["trace_id", "track_id"], order).where("tid = 1").groupBy("_slice").count().collect()]
    assert sum(sizes) == 6000 and 6 <= len(sizes) <= 14 and max(sizes) < 1500
    assert slices.cuts(on_tracks, ["trace_id", "track_id"], order) is None
    out = depth.call_depth(on_tracks, slice_rows=640)
    got = {r["seq"]: (r["parent_ord"], r["depth"]) for r in out.where("tid = 1").collect()}
    assert got == {r["seq"]: (r["parent_ord"], r["depth"]) for r in depth.call_depth(on_tracks).where("tid = 1").collect()}


def test_order_and_segments_in_slices(spark):
    """Tracks dealt to tasks in small slices have the same places and segments."""
    rng = random.Random(21)
    spans = {t: [(rng.randrange(400), rng.choice([0, 1, 2, 30])) for _ in range(n)] for t, n in ((1, 300), (2, 40), (3, 1))}
    on_tracks = normalize.assign_track(frame(spark, [event(i, ts=a, dur=b, tid=t) for t, own in spans.items() for i, (a, b) in enumerate(own)]))
    got = depth.quiescent_segments(depth.track_order_events(on_tracks, slice_rows=20), slice_rows=7)
    want = []
    for t, own in spans.items():
        until, seg = None, 0
        for k, i in enumerate(sorted(range(len(own)), key=lambda i: (own[i][0], -own[i][1], i))):
            seg += until is not None and own[i][0] >= until
            until = max(until if until is not None else -1, sum(own[i]))
            want.append((t, i, k + 1, seg))
    assert rows(got, "tid", "seq", "ord", "seg") == sorted(want)
    assert rows(depth.quiescent_segments(depth.track_order_events(on_tracks)), "tid", "seq", "ord", "seg") == sorted(want)


def test_parents_by_search_equal_the_pass(spark):
    """Also where nothing ever closes, over three levels of blocks, and where parents are far away."""
    rng = random.Random(4)
    tracks_ = {1: [(i, 10_000 - 2 * i) for i in range(900)], 2: [(0, 10_000)] + [(i, 1) for i in range(1, 900)], 3: [(rng.randrange(3000), rng.choice([0, 1, 5, 100, 2000])) for _ in range(900)], 4: [(5, 0), (5, 0), (5, 3)]}
    on_tracks = normalize.assign_track(frame(spark, [event(i, ts=a, dur=b, tid=t) for t, spans in tracks_.items() for i, (a, b) in enumerate(spans)]))
    want = {(r["track_id"], r["ord"], r["parent_ord"]) for r in depth.call_depth(on_tracks).collect() if r["parent_ord"]}
    ended = depth.track_order_events(on_tracks).withColumn("end_ts", F.col("ts") + F.col("dur"))
    for fan in (8, 64):
        assert {(r["track_id"], r["ord"], r["parent_ord"]) for r in depth.resolve_parents(ended, fan).collect()} == want


def test_pairing_nests_by_thread(spark):
    marks = [("parent", "B", 100, 1), ("other", "B", 110, 2), ("child", "B", 120, 1), ("", "E", 130, 1), ("", "E", 140, 2), ("", "E", 150, 1)]
    out = pairing.pair_begin_end(frame(spark, [event(i, n, ph=p, ts=t, tid=d) for i, (n, p, t, d) in enumerate(marks)]))
    assert rows(out, "name", "dur") == [("child", 10), ("other", 30), ("parent", 50)]


@pytest.mark.parametrize(("slice_rows", "kinds", "threads"), [(None, "BbEeX", 6), (30, "BbEeX", 6), (9, "BBBEE", 1), (9, "BEEE", 1), (200, "BE", 2)])
def test_pairing_equals_a_stack(spark, slice_rows, kinds, threads):
    """Also with threads in many slices, deep stacks, and more ends than begins."""
    rng = random.Random(5)
    marks = [(i, rng.choice(kinds), i * 10 + rng.randrange(-15, 15), rng.randrange(threads)) for i in range(400)]
    want, stacks = {}, {}
    for i, ph, ts, tid in marks:
        if ph in "Bb":
            stacks.setdefault(tid, []).append((i, ts))
            want[i] = 0
        elif ph in "Ee":
            if stacks.get(tid):
                j, begin = stacks[tid].pop()
                want[j] = max(0, ts - begin)
        else:
            want[i] = 0
    rng.shuffle(marks)
    out = pairing.pair_begin_end(frame(spark, [event(i, ph=p, ts=t, tid=d) for i, p, t, d in marks]), **({"slice_rows": slice_rows} if slice_rows else {}))
    assert rows(out, "seq", "dur") == sorted(want.items())


def test_args_merge_and_parse(spark):
    df = spark.createDataFrame([('{"arg1":"val1","arg2":42}', '{"arg2":99,"arg3":"val3"}')], "b string, e string")
    merged = df.select(F.inline(args.merge_args(args.parse_args(F.col("b")), args.parse_args(F.col("e")))))
    assert [tuple(r) for r in merged.collect()] == [("arg1", "val1", 0.0), ("arg2", "", 99.0), ("arg3", "val3", 0.0)]
    odd = spark.createDataFrame([('{"u":"12","i":123,"o":{"x":1},"n":null,"t":true}',), ("",), ("[1]",), (None,)], "a string")
    got = [[tuple(a) for a in r["x"]] if r["x"] is not None else None for r in odd.select(args.parse_args(F.col("a")).alias("x")).collect()]
    assert got[0] == [("u", "12", 0.0), ("i", "", 123.0), ("o", '{"x":1}', 0.0), ("n", "null", 0.0), ("t", "true", 0.0)]
    assert got[1:] == [[], [], []]


def test_normalize_cuts_and_saturates(spark):
    big = "999999999999999999999999999999"
    raw = [("t", 0, "123.45", "12.34", "1.0", "2.0"), ("t", 1, "1e2", "1e1", None, None), ("t", 2, big, f"-{big}", "99999999999", "-99999999999"), ("t", 3, "12+34", "1", "1", "1"), ("t", 4, "-1.9", "0", "0", "0")]
    df = spark.createDataFrame(raw, "trace_id string, seq long, ts string, dur string, pid string, tid string")
    df = df.select("*", *(F.lit(None).cast("string").alias(c) for c in ("name", "cat", "ph", "cname", "id", "args")))
    assert rows(normalize.normalize_events(df), "seq", "ts", "dur", "pid", "tid") == [
        (0, 123, 12, 1, 2),
        (1, 100, 10, 0, 0),
        (2, 2**63 - 1, -(2**63), 2**31 - 1, -(2**31)),
        (4, -1, 0, 0, 0),
    ]


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_color_slots(spark):
    out = normalize.color_class(frame(spark, [event(0, "né"), event(1, "x", cname="rail_load"), event(2, ""), event(3, "task", cname="unknown")]))
    assert rows(out, "seq", "color_slot") == [(0, fnv("né") % 8), (1, 1), (2, 0), (3, fnv("task") % 8)]


def test_tracks_order_names_and_counters(spark):
    events = [event(0, ph="X", pid=10, tid=1), event(1, pid=1, tid=2), event(2, pid=1, tid=1)]
    meta = [event(3, "thread_sort_index", ph="M", pid=10, tid=1, args='{"sort_index":"-5"}'), event(4, "thread_sort_index", ph="M", pid=1, tid=2, args='{"sort_index":5}')]
    out = tracks.order_tracks(tracks.organize_tracks(frame(spark, events + meta)))
    assert [(r["pid"], r["tid"]) for r in out.orderBy("track_order").collect()] == [(10, 1), (1, 1), (1, 2)]
    named = [event(i, n, ph="C", id=d) for i, (n, d) in enumerate([("zebra", ""), ("apple", ""), ("APPLE", "2"), ("apple", "1")])]
    out = tracks.order_tracks(tracks.organize_tracks(frame(spark, named)))
    assert [(r["name"], r["id"]) for r in out.orderBy("track_order").collect()] == [("apple", ""), ("apple", "1"), ("APPLE", "2"), ("zebra", "")]
    only = tracks.organize_tracks(frame(spark, [event(0, "thread_name", ph="M", args='{"name":"Meta Only"}')]))
    assert rows(only, "display_name", "event_count") == [("Meta Only", 0)]
    assert rows(aggregates.summary(frame(spark, [event(0, "thread_name", ph="M")]), only), "track_count", "min_ts", "max_ts") == [(1, 0, 0)]


def test_aggregate_and_diff(spark):
    base = frame(spark, [event(0, "A", "cpu", dur=500), event(1, "B", "gpu", dur=1000)])
    target = frame(spark, [event(0, "A", "cpu", dur=800), event(1, "B", "gpu", dur=900), event(2, "C", "cpu", dur=300)])
    by_dur = aggregates.sorted_diff(aggregates.diff_traces(base, target)).collect()
    assert [(r["key"], r["delta_dur"], r["delta_count"]) for r in by_dur] == [("A", 300, 0), ("C", 300, 1), ("B", -100, 0)]
    assert [r["key"] for r in aggregates.sorted_diff(aggregates.diff_traces(base, target), "count").collect()] == ["C", "A", "B"]
    events = frame(spark, [event(0, "task_A", "cpu", dur=500), event(1, "task_B", "gpu", dur=1000), event(2, "task_A", "cpu", dur=300)])
    assert [r["key"] for r in aggregates.aggregate_report(events).collect()] == ["task_A"]
    assert [r["key"] for r in aggregates.aggregate_report(events, least=1).collect()] == ["task_B", "task_A"]
    assert filters.skipped_count(aggregates.aggregate_events(events), 5).first()["skipped"] == 2
    with pytest.raises(ValueError, match="group by"):
        aggregates.aggregate_events(events, "pid")


@pytest.mark.parametrize(
    ("durations", "first", "count", "log"),
    [([0, 50, 5000], (0, 0, 1), 21, False), ([10, 13], (10, 10, 1), 4, False), ([500, 1000], (500, 524, 1), 20, False), ([2, 1000, 100000], (2, 2, 1), 20, True), ([], None, 0, None)],
)
def test_histogram(spark, durations, first, count, log):
    out = histogram.duration_histogram(frame(spark, [event(i, dur=d) for i, d in enumerate(durations)])).orderBy("bucket").collect()
    assert len(out) == count
    if out:
        assert tuple(out[0][c] for c in ("min_dur", "max_dur", "count")) == first
        assert sum(r["count"] for r in out) == len(durations)
        if log is not None and durations[0] > 0:
            assert out[-1]["is_log"] is log


def test_histogram_report_and_bucket(spark):
    events = frame(spark, [event(i, dur=d) for i, d in enumerate([500, 600])])
    hist = histogram.duration_histogram(events)
    shown = histogram.histogram_report(hist).orderBy("bucket").collect()
    assert (shown[0]["max_dur"], shown[0]["percent"], shown[0]["bar"], shown[0]["scale_label"]) == (504, 50.0, 10, "linear")
    assert rows(histogram.bucket_filter(events, hist, 19), "dur") == [(600,)]
    assert histogram.bucket_filter(events, hist, None).count() == 2


def test_concurrency(spark):
    events = frame(spark, [event(0, "task1", ts=1000, dur=1000, tid=1), event(1, "task2", ts=1500, dur=1000, tid=2)])
    out = concurrency.concurrency(nested(events), tracks.organize_tracks(events), concurrency.trace_bounds(events), 2)
    assert [(r["bucket"], round(r["concurrency"], 4)) for r in out.orderBy("bucket").collect()] == [(0, 1.3333), (1, 1.3333)]
    still = frame(spark, [event(0, ts=5)])
    out = concurrency.concurrency(nested(still), tracks.organize_tracks(still), concurrency.trace_bounds(still), 16)
    assert rows(out, "concurrency", "percent") == [(0.0, 0.0)] * 16


def test_heatmap_and_runs(spark):
    spans = [event(0, "a", ts=500, dur=100, tid=1), event(1, "b", ts=5500, dur=100, tid=1), event(2, "c", ts=5500, dur=50, tid=1), event(3, "d", ts=5000, dur=100, tid=2), event(4, "x", ts=17000, dur=1, tid=3)]
    bounds = spark.createDataFrame([("t", 0, 16000)], "trace_id string, lo long, hi long")
    out = concurrency.heatmap(nested(frame(spark, spans)), bounds)
    assert rows(out, "track_id", "bucket", "name") == [("T:1:1", 0, "a"), ("T:1:1", 5, "b"), ("T:1:2", 5, "d"), ("T:1:3", 15, "x")]
    cells = spark.createDataFrame([("k", 0, "a"), ("k", 1, "a"), ("k", 3, "a"), ("k", 4, "b")], "key string, at int, v string")
    assert rows(concurrency.coalesce_runs(cells, ["key"], "at", "v"), "first", "last", "v") == [(0, 1, "a"), (3, 3, "a"), (4, 4, "b")]


def test_search(spark):
    events = [event(0, "foo", "bar", args='{"x":"1"}'), event(1, "hello", "world", args='{"x":"a FOO b","n":5}'), event(2, "baz", "bar", ph="C"), event(3, "Foo", ph="C"), event(4, "thread_name", ph="M", args='{"name":"foo"}'), event(5, "FÖÖ")]
    df = args.with_args(frame(spark, events))
    assert rows(df.where(filters.search("foo")), "seq") == [(0,), (1,), (3,), (4,)]
    assert rows(df.where(filters.search("foo", counters=False)), "seq") == [(0,), (1,), (4,)]
    assert rows(df.where(filters.search("foo", threads=False)), "seq") == [(3,), (4,)]
    assert df.where(filters.search("")).count() == 6


def test_events_at_equals_brute_force(spark):
    """Spans from 1 µs to a year, so that most are on levels of their own; both ends of each, and the instants beside them."""
    spans = [(ts, dur) for ts in (0, 7, 1000) for dur in (0, 1, 9, 10, 11, 640, 31_536_000_000_000)]
    events = frame(spark, [event(i, ts=ts, dur=dur) for i, (ts, dur) in enumerate(spans)])
    ats = sorted({t + d for ts, dur in spans for t in (ts, ts + dur) for d in (-1, 0, 1)})
    probes = spark.createDataFrame([(k, "t", at) for k, at in enumerate(ats)], "probe_id long, trace_id string, at long")
    want = sorted((k, i) for k, at in enumerate(ats) for i, (ts, dur) in enumerate(spans) if ts <= at < ts + dur)
    for width in (1, 10, 1_000_000):
        assert rows(inspect.events_at(events, probes, width), "probe_id", "seq") == want


@pytest.mark.parametrize("slice_rows", [1, 3, 40, 1 << 18])
def test_events_at_totals_equal_brute_force(spark, slice_rows, monkeypatch):
    """Nested, equal, long and empty spans of two traces, in slices of few instants: never a pair, the same totals."""
    monkeypatch.setattr(inspect.slices, "ROW_BYTES", 0)
    rng = random.Random(slice_rows)
    spans = [(t, rng.randrange(0, 120), rng.choice([0, 1, 5, 40, 1000])) for t in "tu" for _ in range(60)] + [("t", 50, 10)] * 9
    events = frame(spark, [event(i, ts=ts, dur=dur, trace=t) for i, (t, ts, dur) in enumerate(spans)])
    asked = [(k % 150, t, rng.randrange(-5, 1200) if k % 2 else 50) for k, t in enumerate("tuv" * 70)]
    probes = spark.createDataFrame(asked, "probe_id long, trace_id string, at long")
    monkeypatch.setattr(inspect, "events_at", None)
    found = rows(inspect.events_at_totals(events, probes, slice_rows), "probe_id", "trace_id", "at", "events", "first", "last")
    want = []
    for k, t, at in asked:
        held = [i for i, (own, ts, dur) in enumerate(spans) if own == t and ts <= at < ts + dur]
        want += [(k, t, at, len(held), held[0], held[-1])] if held else []
    assert found == sorted(want)
    assert inspect.events_at_totals(events.limit(0), probes, slice_rows).isEmpty()


def test_nearest_edge_goes_through_rows_once(spark):
    """60,000 edges and probes in one bucket, which a shrinking window would go through 60,000 times; and ties."""
    events = frame(spark, []).unionByName(spark.range(30_000).select(F.lit("t").alias("trace_id"), F.col("id").alias("seq"), *(F.lit("").alias(c) for c in ("name", "cat", "ph", "cname", "id", "args_json")), (F.col("id") * 4).alias("ts"), F.lit(0).cast("long").alias("dur"), F.lit(1).alias("pid"), F.lit(1).alias("tid")))
    probes = spark.range(30_000).select(F.col("id").alias("probe_id"), F.lit("t").alias("trace_id"), (F.col("id") * 4 + F.col("id") % 4).alias("at"))
    near = inspect.nearest_edge(events, probes, 1_000_000)
    assert "unboundedfollowing" not in near._jdf.queryExecution().analyzed().toString().lower()
    want = F.col("at") - F.col("at") % 4 + F.when(F.col("at") % 4 == 3, 4).otherwise(0)
    last = 4 * 29_999
    assert near.count() == 30_000 and near.where((F.col("edge") != F.least(want, F.lit(last))) | (F.col("distance") != F.abs(F.col("at") - F.col("edge")))).isEmpty()


def test_wide_totals_hold_what_longs_do_not(spark):
    far = (1 << 63) - 1
    base = frame(spark, [event(0, "a", dur=far), event(1, "a", dur=far), event(2, "b", dur=5)])
    target = frame(spark, [event(0, "a", dur=1), event(1, "c", dur=2)])
    wide = aggregates.narrowed(aggregates.diff_traces(base, target, wide=True))
    assert dict(wide.dtypes)["base_dur"] == "decimal(38,0)"
    assert rows(wide, "key", "base_dur", "target_dur", "delta_dur", "delta_count") == [("a", 2 * far, 1, 1 - 2 * far, -1), ("b", 5, 0, -5, -1), ("c", 0, 2, 2, 1)]
    few = aggregates.narrowed(aggregates.diff_traces(base.where("seq > 0"), target, wide=True))
    plain = aggregates.diff_traces(base.where("seq > 0"), target)
    assert few.dtypes == plain.dtypes and sorted(few.collect()) == sorted(plain.collect())
    assert aggregates.narrowed(aggregates.diff_traces(base.limit(0), target.limit(0), wide=True)).dtypes == plain.dtypes


@pytest.mark.parametrize("size", [1, 3, 64])
def test_what_slices_leave_open_equals_a_stack(size):
    """Slices within and across batches, told without a loop over events."""
    rng = random.Random(size)
    events = sorted((f"T:{rng.randrange(3)}", rng.randrange(3), rng.randrange(40), -rng.choice([0, 1, 5, 30]), k) for k in range(200))
    kinds = [rng.choice(["THREAD", "THREAD", "COUNTER"]) for _ in events]
    batches = []
    for low in range(0, len(events), size):
        few = events[low : low + size]
        columns = {"trace_id": ["t"] * len(few), "track_id": [e[0] for e in few], "_slice": [e[1] for e in few], "track_type": kinds[low : low + size], "ts": [e[2] for e in few], "dur": [-e[3] for e in few]}
        batches += pa.table(columns).to_batches()
    want = {}
    for (track, piece, ts, less, _), kind in zip(events, kinds, strict=True):
        state = want.setdefault((track, piece), [0, -1, 0, []])
        end = ts - less
        state[:3] = [state[0] + 1, max(state[1], end), ts]
        while state[3] and not (state[3][-1][1] >= end and state[3][-1][1] > ts):
            state[3].pop()
        state[3] += [(state[0], end)] if kind != "COUNTER" else []
    found = [r for b in depth._left_open(iter(batches)) for r in b.to_pylist()]
    assert [(r["track_id"], r["_slice"], r["events"], r["last_end"], r["last_ts"], list(zip(r["ords"], r["ends"], strict=True))) for r in found] == [(*k, *v) for k, v in want.items()]
    assert depth._open_at_ends(batches[0], ("trace_id", "track_id", "_slice"))


def test_inspect(spark):
    events = frame(spark, [event(0, "parent_task", ts=1000, dur=1000), event(1, "child_task_A", ts=1100, dur=300), event(2, "child_task_B", ts=1500, dur=400), event(3, "thread_name", ph="M", args='{"name":"main"}')])
    found = tracks.order_tracks(tracks.organize_tracks(events))
    top = inspect.inspect(nested(events), found, "main", 1000).first()
    assert (top["self_dur"], top["depth"], top["parent_name"], [c["name"] for c in top["children"]]) == (300, 0, None, ["child_task_A", "child_task_B"])
    child = inspect.inspect(nested(events), found, "main", 1100).first()
    assert (child["self_dur"], child["depth"], child["parent_name"], child["parent_ts"], child["children"]) == (300, 1, "parent_task", 1000, [])
    with pytest.raises(ValueError, match="no track is called 'none'"):
        inspect.inspect(nested(events), found, "none", 1000)


def test_query_filters(spark):
    events = frame(
        spark,
        [event(0, "thread_name", ph="M", tid=1, args='{"name":"main_thread"}'), event(1, "thread_name", ph="M", tid=2, args='{"name":"worker_thread"}'), event(2, "parent_task", "cpu", ts=1000, dur=1000), event(3, "child_task_A", "cpu", ts=1100, dur=300), event(4, "network_request", "net", ts=1500, dur=800, tid=2), event(5, "render_frame", "gpu", ts=2000, dur=500)],
    )
    found = tracks.order_tracks(tracks.organize_tracks(events))
    on = nested(events).join(found.select("trace_id", "track_id", "track_order"), ["trace_id", "track_id"])
    names = lambda df: [r["name"] for r in df.collect()]
    assert names(aggregates.query_events(on.where(filters.match_text("task") & filters.max_depth(0)))) == ["parent_task"]
    assert names(aggregates.query_events(on.where(filters.overlaps(1200)), 1)) == ["parent_task"]
    assert names(filters.on_track(on, found, "worker_thread")) == ["network_request"]
    assert sorted(names(filters.region_select(on, found.where("tid = 1"), 1900, 3000, 0, 0))) == ["parent_task", "render_frame"]


def sequential_blocks(spans, t0, t1, cell):
    """One pass over the events in track order, cell by cell."""
    first = t0 // cell * cell
    last = first + -(-(t1 - first) // cell) * cell
    blocked, out, open_ = {}, [], {}
    for i, ts, dur, d in spans:
        if ts < first:
            if ts + dur > t0:
                out.append((d, ts, max(ts + dur, ts + cell), 1, i))
                blocked[d] = max(blocked.get(d, -1), ts + dur)
    for at in range(first, last, cell):
        shut = {d: end >= at + cell for d, end in blocked.items()}
        open_ = {}
        for i, ts, dur, d in spans:
            if at <= ts < at + cell:
                if dur >= cell:
                    out.append((d, ts, ts + dur, 1, i))
                    shut[d] = True
                    blocked[d] = max(blocked.get(d, -1), ts + dur)
                elif not shut.get(d):
                    best = open_.setdefault(d, [0, -1, None])
                    best[0] += 1
                    if dur > best[1]:
                        best[1:] = [dur, i]
        out += [(d, at, at + cell, n, i) for d, (n, _, i) in open_.items()]
    return sorted(out)


@pytest.mark.parametrize("cut", [{"slice_rows": 1 << 62}, {"slice_rows": 0, "slice_cells": 1}, {"slice_rows": 0, "slice_cells": 3}])
def test_downsample_timeline_equals_one_pass(spark, cut):
    rng = random.Random(11)
    events = frame(spark, [event(i, ts=rng.randrange(60), dur=rng.choice([0, 1, 2, 4, 9]), tid=t) for t in range(12) for i in range(t * 100, t * 100 + 18)])
    flat = nested(events).cache()
    out = timeline.downsample_timeline(flat, 10, 47, 3, **cut)
    for t in range(12):
        mine = sorted((r["ord"], r["seq"], r["ts"], r["dur"], r["depth"]) for r in flat.where(F.col("tid") == t).collect())
        want = sequential_blocks([m[1:] for m in mine], 10, 47, 3)
        assert rows(out.where(F.col("track_id") == f"T:1:{t}"), "depth", "start_ts", "end_ts", "count", "seq") == want


def test_downsample_small_events_merge(spark):
    out = timeline.downsample_timeline(nested(frame(spark, [event(i, ts=t, dur=5) for i, t in enumerate((100, 105, 110))])), 0, 10_000, 30)
    assert rows(out, "start_ts", "end_ts", "count") == [(90, 120, 3)]


def test_counters(spark):
    events = [event(0, "c", ph="C", ts=10, args='{"a":10}'), event(1, "c", ph="C", ts=11, args='{"a":1}'), event(2, "c", ph="C", ts=20, args='{"a":3,"b":4}'), event(3, "c", ph="C", ts=31, args='{"b":2}')]
    df = args.with_args(depth.track_order_events(normalize.assign_track(frame(spark, events))))
    series = counters.counter_series(df)
    assert series.first()["series"] == ["a", "b"]
    assert counters.counter_max_total(df).first()["max_total"] == 10.0
    peaks = counters.downsample_counters(df, series, 0, 100, 3)
    got = {(r["cell"], r["series"]): (r["start_ts"], r["end_ts"], r["peak"]) for r in peaks.collect()}
    assert got[3, "a"] == (10, 12, 10.0)  # the peak within the cell
    assert got[4, "a"] == (12, 15, 1.0)  # carried on
    assert got[6, "b"] == (18, 21, 4.0)
    assert got[9, "a"] == (27, 30, 3.0)
    assert max(end for _, end, _ in got.values()) == 31
    assert rows(counters.stack_series(peaks.where("cell = 6")), "series", "low", "high") == [("a", 0.0, 3.0), ("b", 3.0, 7.0)]
    shown = [(r["label"], r["value"]) for r in counters.counter_totals(df, series).where("seq = 2").collect()]
    assert shown == [("b", 4.0), ("a", 3.0), ("Total", 7.0)]


def sequential_peaks(events, t0, t1, cell):
    """One pass over a track's events in order, cell by cell."""
    events = sorted(events, key=lambda e: (e[0], e[2]))
    first_ts, last_ts = events[0][0], events[-1][0]
    if not (t1 > first_ts and t0 < last_ts):
        return {}
    begin = max(t0 // cell, first_ts // cell)
    end = min(-(-t1 // cell) - 1, max(-(-last_ts // cell) - 1, begin))
    names = {k for _, args_, _ in events for k in args_}
    before = [a for ts, a, _ in events if ts // cell < begin]
    value = {n: (before[-1].get(n, 0.0) if before else 0.0) for n in names}
    out = {}
    for c in range(begin, end + 1):
        start, stop = max(c * cell, first_ts, t0), min((c + 1) * cell, last_ts, t1)
        for n in names:
            here = [a[n] for ts, a, _ in events if ts // cell == c and n in a]
            peak = max(here) if here else value[n]
            value[n] = here[-1] if here else value[n]
            if stop > start:
                out[c, n] = (start, stop, peak)
    return out


def test_counter_peaks_equal_one_pass(spark):
    rng = random.Random(14)
    tracks_ = {t: [(rng.randrange(0, 60), {n: float(rng.randrange(-9, 9)) for n in rng.sample("abc", rng.randrange(0, 3))}, i) for i in range(rng.randrange(1, 12))] for t in range(60)}
    events = [event(i, f"c{t}", ph="C", ts=ts, args=json.dumps(a)) for t, own in tracks_.items() for ts, a, i in own]
    df = args.with_args(normalize.assign_track(frame(spark, events)).repartition(5))
    names = {r["track_id"]: r["name"] for r in df.select("track_id", "name").distinct().collect()}
    for t0, t1, cell in ((0, 100, 7), (20, 41, 3), (33, 34, 1), (70, 90, 5)):
        got = {}
        for r in counters.downsample_counters(df, None, t0, t1, cell).collect():
            got.setdefault(names[r["track_id"]], {})[r["cell"], r["series"]] = (r["start_ts"], r["end_ts"], r["peak"])
        assert got == {f"c{t}": want for t, own in tracks_.items() if (want := sequential_peaks(own, t0, t1, cell))}


def test_range_and_nearest_joins(spark):
    events = frame(spark, [event(0, "a", ts=100, dur=50), event(1, "b", ts=120, dur=500), event(2, "c", ts=130)])
    probes = spark.createDataFrame([(1, "t", 100), (2, "t", 149), (3, "t", 150), (4, "t", 5000)], "probe_id long, trace_id string, at long")
    assert rows(inspect.events_at(events, probes, 64), "probe_id", "name") == [(1, "a"), (2, "a"), (2, "b"), (3, "b")]
    near = rows(inspect.nearest_edge(events, probes, 15).na.fill(-1), "probe_id", "edge")
    assert near == [(1, 100), (2, 150), (3, 150), (4, -1)]


def test_registered_joins_of_all_probes_with_all_spans(spark, tmp_path):
    rng = random.Random(12)
    kinds = ["purchase", "signup", "view", "error"]
    happened = [(i, f"2024-01-{rng.randrange(1, 31):02} {rng.randrange(24):02}:{rng.randrange(60):02}:00", i % 7, rng.choice(kinds), rng.randrange(9000) / 100, "{}") for i in range(150)]
    table = spark.createDataFrame(happened, "event_id long, at string, user_id long, event_type string, value double, props string")
    table.withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at").write.parquet(f"file://{tmp_path}/events.parquet")
    keys = rng.sample(range(1, 50_000), 200)
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"file://{tmp_path}/orders.parquet")
    every, d = catalog.queries(), f"file://{tmp_path}"
    spans = [(r["seq"], r["ts"], r["ts"] + r["dur"]) for r in catalog.spans(spark, d).collect()]
    assert len(spans) == 150
    at = {k: sql.START + k * 60_000_000 % (30 * 86_400_000_000) for k in keys}
    held = {k: sorted(seq for seq, a, b in spans if a <= at[k] < b) for k in keys}
    want = sorted((k, len(s), s[0], s[-1]) for k, s in held.items() if s)
    assert len(want) > 100
    assert rows(every["j8_events_at_all"](spark, d), "probe_id", "events", "first", "last") == want
    edges = {e for _, a, b in spans for e in (a, b)}
    near = {k: min((abs(t - e), e) for e in edges) for k, t in at.items()}
    close = {k: (e, n) if n < 300_000_000 else (None, None) for k, (n, e) in near.items()}
    assert {r["probe_id"]: (r["edge"], r["distance"]) for r in every["j9_nearest_edge_all"](spark, d).collect()} == close
    assert any(e is not None for e, _ in close.values())


def test_hottest_window(spark):
    df = spark.createDataFrame([("t", f"T:{i}", i + 1, n) for i, n in enumerate([1, 9, 2, 9, 1])], "trace_id string, track_id string, track_order int, event_count long")
    assert rows(tracks.hottest_track_window(df, 3), "track_order") == [(2,), (3,), (4,)]
    assert tracks.hottest_track_window(df, 9).count() == 5


def test_empty_events(spark):
    none = frame(spark, [])
    assert nested(none).count() == 0
    assert tracks.organize_tracks(none).count() == 0
    assert aggregates.auto_bin_counts(none).count() == 0
    assert pairing.pair_begin_end(none).count() == 0
