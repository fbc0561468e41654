from __future__ import annotations

import datetime
import glob
import gzip
import io
import json
import os
import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.helpers import event, frame, rows
from tracelark.functions import scalars
from tracelark.operators import depth, normalize, timeline
from tracelark.plans import catalog
from tracelark.sources import json_ranges, trace_files
from tracelark.sources import stored as stored_events
from tracelark.sources.schema import EVENT_COLUMNS
from tracelark.streaming import events as streams
from tracelark.streaming import landing

SPANS = '[{"name":"lift","cat":"crane","ph":"X","ts":70,"dur":8,"pid":2,"tid":5},\n{"name":"lower","ph":"B","ts":91.6,"pid":2,"tid":5,"args":{"load":[{"kg":3}]}},\n{"name":"odd","ts":"9x"}\n]\n'


def test_read_trace_roots(spark, tmp_path):
    (tmp_path / "a.json").write_text(SPANS)
    (tmp_path / "b.json").write_text('{"displayTimeUnit":"ms","traceEvents":[{"name":"solo"}]}')
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text('{"traceEvents":[]}')
    (tmp_path / "e.json.gz").write_bytes(gzip.compress(b'[{"name":"zip","ts":3e2}]'))
    read = lambda name: rows(trace_files.read_trace(spark, f"file://{tmp_path}/{name}"), "name", "ts")
    assert read("a.json") == [("lift", 70), ("lower", 91)]
    assert read("b.json") == [("solo", 0)]
    assert read("c.json") == read("d.json") == []
    assert read("e.json.gz") == [("zip", 300)]


def test_read_lines_keeps_order_and_drops_bad_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(SPANS)
    (tmp_path / "b.json").write_text('{"traceEvents":[{"name":"i"},{"name":"ii"},\n{"name":"iii","args":{"l":[{"z":1}]}},\nnot json,\n{"name":"iv \u2028 \x0c"},{"name":"v"}],"unit":["ms"]}\n')
    out = trace_files.read_trace_lines(spark, f"file://{tmp_path}/a.json")
    assert rows(out, "name", "ts", "args_json") == [("lift", 70, ""), ("lower", 91, '{"load":[{"kg":3}]}')]
    out = trace_files.read_trace_lines(spark, f"file://{tmp_path}/b.json").orderBy("seq").collect()
    assert [r["name"] for r in out] == ["i", "ii", "iii", "iv \u2028 \x0c", "v"]
    assert rows(trace_files.bad_lines(spark, f"file://{tmp_path}/b.json"), "lines", "bad") == [(4, 1)]


def test_numbers_are_unique_and_in_order_over_files_and_blocks(spark, tmp_path):
    """Three line files in many small blocks, and documents, each as one trace."""
    for k in range(3):
        (tmp_path / f"part {k}.json").write_text("\n".join('{"name":"%06d"},' % (k * 1000 + i) for i in range(1000)))
        (tmp_path / f"doc{k}.txt").write_text('{"traceEvents":[' + ",".join('{"name":"%d"}' % (2 * k + i) for i in range(2)) + "]}")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        read = trace_files.read_trace_lines(spark, f"file://{tmp_path}/*.json", "t")
        assert read.rdd.getNumPartitions() > 6
        out = read.select("seq", "name", "trace_id").collect()
        docs = trace_files.read_trace(spark, f"file://{tmp_path}/*.txt", "t").select("seq", "name").collect()
        zipped = trace_files.read_gzip_trace(spark, f"file://{tmp_path}/*.txt", "t").select("seq", "name").collect()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert len({r["seq"] for r in out}) == 3000 and {r["trace_id"] for r in out} == {"t"}
    assert [r["name"] for r in sorted(out)] == sorted(r["name"] for r in out)
    for found in (docs, zipped):
        assert [r["name"] for r in sorted(found)] == list("012345") and len({r["seq"] for r in found}) == 6


def test_gzip_by_magic(spark, tmp_path):
    (tmp_path / "x.json").write_bytes(gzip.compress('[{"name":"zip"},\n{"name":"z\x85p"}]'.encode()))
    (tmp_path / "y.json").write_bytes(b'[{"name":"plain"}]')
    pretty = '{\n "meta": {"a": [{"name": "no"}]},\n "traceEvents": [\n  {\n   "name": "pre]tty \\"{",\n   "args": {"x": [{"y": 1}]}\n  },\n  {"name": "last"}\n ],\n "more": [{"name": "no"}]\n}'
    (tmp_path / "z").write_bytes(gzip.compress(pretty.encode()[:90]) + gzip.compress(pretty.encode()[90:]))
    (tmp_path / "w.json").write_bytes(b'[{"name":"before"},{"name":"cut')
    want = [("before",), ("last",), ("plain",), ('pre]tty "{',), ("zip",), ("z\x85p",)]
    assert rows(trace_files.read_gzip_trace(spark, f"file://{tmp_path}"), "name") == sorted(want)
    for raw in (b"\x1f\x8bgarbage", gzip.compress(SPANS.encode())[:-9]):
        (tmp_path / "x.json").write_bytes(raw)
        with pytest.raises(Exception, match="gzip file"):
            trace_files.read_gzip_trace(spark, f"file://{tmp_path}").collect()


def in_ranges(text, cuts):
    """Events of a document of which each range is a task's: what begins where is told by composing what they say alone."""
    pieces = text.encode().split(b"}")
    rows, place, edges = [], {"_path": "f", "file_size": len(text.encode())}, [0, *cuts, len(pieces)]
    meta = lambda i: pa.RecordBatch.from_pylist([place | {"_start": i, "value": p} for p in pieces[edges[i] : edges[i + 1]]])
    ranges = [i for i in range(len(edges) - 1) if edges[i] < edges[i + 1]]
    summary = [b for i in ranges for b in json_ranges._summarised(iter([meta(i)]))]
    for state in pa.Table.from_batches(json_ranges._composed(iter(summary))).to_pylist():
        here = place | state
        for fragments in (False, True):
            rows += list(json_ranges._events_of(here, iter(pieces[edges[state["_start"]] : edges[state["_start"] + 1]]), fragments))
    out = {}
    for r in rows:
        out.setdefault((r["_start"], r["at"] if r["at"] >= 0 and r["last"] and r["part"] == r["_start"] else "cut"), []).append(r)
    events = []
    for key in sorted(out, key=lambda k: (k[0], k[1] == "cut", k[1] if k[1] != "cut" else 0)):
        group = sorted(out[key], key=lambda r: r["part"])
        if any(r["last"] for r in group) and not any(r["cancelled"] for r in group):
            events.append(b"".join(r["value"] for r in group).decode())
    return events


def test_pair_is_written_in_few_whole_documents(spark, tmp_path, monkeypatch):
    """A trace of many threads is no file a thread, and a thread's events are in order, in documents of bounded size."""
    rng = random.Random(4)
    order = [(k, datetime.datetime(1995, 1, 1) + datetime.timedelta(days=k)) for k in range(300)]
    items = [(k % 300, k // 300, rng.choice([None, *range(400)]), datetime.datetime(1996, 1, 1) + datetime.timedelta(days=rng.randrange(400))) for k in range(1500)]
    spark.createDataFrame(order, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"file://{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp_ntz").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    seen, read = [], trace_files.read_trace_pair
    monkeypatch.setattr(trace_files, "read_trace_pair", lambda spark, *paths: seen.extend(paths) or read(spark, *paths))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "8k")
        out = {r["key"]: (r["base_dur"], r["base_count"], r["target_dur"], r["target_count"]) for r in catalog.queries()["s4_read_trace_pair"](spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    want, starts = {}, dict(order)
    for key, line, supplier, shipped in items:
        if supplier is not None:
            a = want.setdefault(f"line{line}", [0, 0, 0, 0])
            a[supplier % 2 * 2] += max(0, round((shipped - starts[key]).total_seconds() * 1e6))
            a[supplier % 2 * 2 + 1] += 1
    assert out == {k: tuple(a) for k, a in want.items()}
    for half, path in enumerate(seen):
        files = sorted(f for f in glob.glob(f"{path.removeprefix('file://')}/**", recursive=True) if os.path.basename(f).startswith("part-"))
        assert len(files) < 30 and max(map(os.path.getsize, files)) <= 8 << 10
        tids = [e["tid"] for f in files for e in json.load(open(f))["traceEvents"]]
        assert set(tids) == {i[2] for i in items if i[2] is not None and i[2] % 2 == half} and len(tids) == sum(i[2] is not None and i[2] % 2 == half for i in items)
        assert sum(a != b for a, b in zip(tids, tids[1:], strict=False)) == len(set(tids)) - 1  # each thread in a row


def test_documents_without_events_and_long_threads(spark, tmp_path):
    events = frame(spark, [event(seq=i, name=f"n{i}", ts=i, args='{"k":"}{"}' if i % 3 else "") for i in range(1000)])
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "4k")
        trace_files.write_documents(events.repartition(3), f"file://{tmp_path}/long")
        trace_files.write_documents(events.limit(0), f"file://{tmp_path}/none")
        got = trace_files.read_trace(spark, f"file://{tmp_path}/long", "t").orderBy("seq").collect()
        assert [(r["name"], r["ts"], r["args_json"]) for r in got] == [(f"n{i}", i, '{"k":"}{"}' if i % 3 else "") for i in range(1000)]
        assert trace_files.read_trace(spark, f"file://{tmp_path}/none", "t").count() == 0
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_documents_are_parsed_once_and_no_null_lists_go_to_python(spark, tmp_path, monkeypatch):
    """A filter moved below the parsing would parse each event again; and at each row Spark asks for the size of the batch so
    far, for which Arrow goes through all null lists."""
    (tmp_path / "small.json").write_text('[{"name":"a"}]')
    (tmp_path / "large.json").write_text("[" + ",".join('{"name":"%d"}' % i for i in range(3000)) + "]")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    found = json_ranges._FOUND
    none = {"_path": "", "_start": 0, "at": 0, "part": 0, "last": True, "cancelled": False}
    kinds = lambda _: lambda batches: (pa.RecordBatch.from_pylist([none | {"value": str(b.schema.types).encode()}], found) for b in batches)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "4k")
        assert trace_files.read_trace(spark, f"file://{tmp_path}/small.json", "t")._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
        monkeypatch.setattr(json_ranges, "_reader", kinds)
        for name in ("small", "*"):
            seen = [bytes(r["value"]) for r in json_ranges.document_events(spark, f"file://{tmp_path}/{name}.json")[0].select("value").collect()]
            assert seen and not any(b"List" in kind for kind in seen)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


@pytest.mark.parametrize("chunk", [1, 200, 1 << 20])
def test_documents_in_ranges_of_any_length(monkeypatch, chunk):
    """Strings with braces, brackets and escapes, nested arguments and other keys, cut at every brace and at random ones."""
    monkeypatch.setattr(json_ranges, "CHUNK", chunk)
    rng = random.Random(2)
    odd = ['a}b', 'x\\"}{[', "]", "\\\\", '"traceEvents":[', "}}", "\u007d"]
    documents = []
    for k in range(40):
        events = []
        for i in range(rng.randrange(12)):
            name = json.dumps(rng.choice(odd) + str(i)) if rng.random() < 0.7 else f'"{i}"'
            events.append('{"name":%s,"args":%s}' % (name, rng.choice(['{"x":[{"y":"}"}]}', "{}", '{"a":{"b":{"c":[]}}}', "3"])))
        inner = rng.choice([",", ",\n", " , "]).join(events)
        documents.append((events, [f"[{inner}]", '{"traceEvents":[%s]}' % inner, '{"m":{"traceEvents":[{"no":1}]},"z":[{"no":2}],"traceEvents" : [%s],"more":[{"no":{}}],"s":"}"}' % inner, "\n".join(events)][k % 4]))
    for events, text in documents:
        n = len(text.encode().split(b"}"))
        assert in_ranges(text, []) == events
        assert in_ranges(text, list(range(1, n))) == events
        for _ in range(10):
            assert in_ranges(text, sorted(rng.sample(range(1, n), min(n - 1, rng.randrange(4))))) == events, text


def test_one_large_document_is_read_by_many_tasks(spark, tmp_path):
    """Without a line end, and with events longer than a range; then with a broken byte and cut off."""
    named = [f"n{i}" + "}{" * (i % 3) for i in range(3000)]
    body = ",".join(json.dumps({"name": n, "ts": i, "args": {"k": [{"v": "x" * (9000 if i % 500 == 7 else i % 90)}]}}) for i, n in enumerate(named))
    (tmp_path / "whole.json").write_text('{"meta":{"a":[{"name":"no"}]},"traceEvents":[' + body + '],"more":[{"name":"no"}]}')
    (tmp_path / "zipped.json").write_bytes(gzip.compress((tmp_path / "whole.json").read_bytes(), 0))
    (tmp_path / "broken.json").write_bytes(b"[" + body.encode()[:150_000] + b"\xff\x00][,,{{{")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, "4k")
        read = trace_files.read_trace(spark, f"file://{tmp_path}/whole.json", "t")
        assert read.rdd.getNumPartitions() >= 8
        out = read.orderBy("seq").select("name", "ts", "seq").collect()
        zipped = trace_files.read_trace(spark, f"file://{tmp_path}/zipped.json", "t").orderBy("seq").select("name", "ts").collect()
        broken = trace_files.read_trace(spark, f"file://{tmp_path}/broken.json", "t").orderBy("seq").select("name").collect()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert [(r["name"], r["ts"]) for r in out] == [(n, i) for i, n in enumerate(named)] and len({r["seq"] for r in out}) == 3000
    assert [(r["name"], r["ts"]) for r in zipped] == [(r["name"], r["ts"]) for r in out]
    kept = [r["name"] for r in broken]
    assert len(kept) > 500 and kept == named[: len(kept)]


def test_lines_round_trip_and_stored_events(spark, tmp_path):
    events = frame(spark, [event(1, 'qu"ote', "c", ts=5, dur=2, args='{"k":1}'), event(2, "plain", ts=9)])
    trace_files.event_lines(events).write.text(f"file://{tmp_path}/lines")
    assert rows(trace_files.read_trace_lines(spark, f"file://{tmp_path}/lines"), "name", "ts", "dur", "args_json") == [("plain", 9, 0, ""), ('qu"ote', 5, 2, '{"k":1}')]
    trace_files.write_events(events, f"file://{tmp_path}/stored")
    assert rows(spark.read.parquet(f"file://{tmp_path}/stored").where("end_ts >= 8"), "name") == [("plain",)]
    with pytest.raises(ValueError, match="parquet, json or csv"):
        trace_files.write_report(events, f"file://{tmp_path}/r", "xml")
    with pytest.raises(ValueError, match="no such event columns"):
        trace_files.from_table(events, {"colour": "1"})


def shuffled(spark, n=20_000, threads=4):
    """Events of a few threads in any order."""
    every = spark.range(n).selectExpr("'t' trace_id", "id seq", "concat('n', id % 7) name", "'' cat", "'X' ph", "'' cname", "'' key", "id * 10 ts", "(id % 13) * 3 dur", "1 pid", f"cast(id % {threads} as int) tid", "'' args_json")
    return every.withColumnRenamed("key", "id").repartition(8, F.rand(3))


@pytest.mark.parametrize("by", ["time", "thread"])
def test_a_narrow_window_opens_few_files(spark, tmp_path, by):
    """Of events that come in any order; and the timeline of a window reads in proportion to it."""
    events = shuffled(spark, threads=4 if by == "time" else 1)
    path = f"file://{tmp_path}/stored"
    trace_files.write_events(depth.call_depth(normalize.assign_track(events)).drop("end_ts"), path, by=by, files=40)
    whole = spark.read.parquet(path)
    assert whole.count() == 20_000 and 30 <= len(whole.inputFiles()) <= 40
    read = []
    for t0, t1 in ((100_000, 101_999), (50_000, 69_999), (0, 199_999), (10**9, 10**9 + 5)):
        some = trace_files.read_events(spark, path, t0, t1)
        want = whole.where(f"end_ts >= {t0} and ts <= {t1}")
        assert rows(some, "seq", "ts") == rows(want, "seq", "ts")
        read.append(len(some.inputFiles()))
        stored, plain = timeline.stored_timeline(spark, path, t0, t1, 50), timeline.downsample_timeline(whole, t0, t1, 50)
        columns = ("track_id", "depth", "start_ts", "end_ts", "count", "seq")
        assert rows(stored, *columns) == rows(plain, *columns)
    assert read[0] <= 3 and read[1] <= 8 and read[3] == 0
    assert rows(trace_files.read_events(spark, path, min_dur=36), "seq") == rows(whole.where("dur >= 36"), "seq")
    one = spark.createDataFrame([("t", 1, 0)], "trace_id string, pid int, tid int")
    assert rows(trace_files.read_events(spark, path, 10, 5000, threads=one), "seq") == rows(whole.where("tid = 0 and end_ts >= 10 and ts <= 5000"), "seq")
    held = stored_events.zones(spark, path)
    assert held.agg(F.sum("events")).first()[0] == 20_000
    with pytest.raises(ValueError, match="by thread or time"):
        trace_files.write_events(events, f"{path}2", by="name")


def test_format_duration(spark):
    df = spark.createDataFrame([(0.0,), (12.0,), (1500.0,), (1234567.0,), (-2500.0,), (999.999,)], "us double")
    shown = [r[0] for r in df.select(scalars.format_duration(df.us)).collect()]
    assert shown == ["0", "12 us", "1.5 ms", "1.23 s", "-2.5 ms", "1000 us"]


def test_stream_pairs_across_batches(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    first = [event(1, "outer", ph="B", ts=100), event(2, "inner", ph="B", ts=110), event(3, "point", ts=111)]
    second = [event(4, ph="E", ts=130), event(5, ph="E", ts=180), event(6, ph="E", ts=190)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, batch in enumerate((first, second)):
        frame(spark, batch).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(streams.EVENT_SCHEMA).parquet(path)
        run = streams.stream_pair_begin_end(stream).writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/at")
        run.trigger(availableNow=True).option("path", f"file://{tmp_path}/out").format("parquet").start().awaitTermination()
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == (1, 3)[k]
    assert rows(spark.read.parquet(f"file://{tmp_path}/out"), "name", "dur") == [("inner", 20), ("outer", 80), ("point", 0)]


def drained(stream, tmp_path, mode="append"):
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).option("path", f"file://{tmp_path}/out").format("parquet").start().awaitTermination()


def test_landed_files_are_numbered_in_order(spark, tmp_path):
    """Two files of one instant, a restart, lines of several events, and one large file in many ranges."""
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("b", "a"):
        (folder / f"{name}.json").write_text("\n".join('{"name":"%s%d"},{"name":"%s%d+"},' % (name, i, name, i) for i in range(3)))
        os.utime(folder / f"{name}.json", ns=(10**18, 10**18))
    read = lambda: streams.stream_events(spark, f"file://{folder}", "t", range_bytes=1 << 20)
    drained(read(), tmp_path)
    n = 200_000
    (folder / "0-late.json").write_text("\n".join('{"name":"n%06d","ts":%d},' % (i, i) for i in range(n)))
    os.utime(folder / "0-late.json", ns=(1, 1))  # it lands later, whatever it says
    (folder / "z.json.gz").write_bytes(gzip.compress(b'{"name":"zip"}\n{"name":"zap"}'))
    drained(read(), tmp_path)
    out = spark.read.parquet(f"file://{tmp_path}/out").orderBy("seq").select("seq", "name").collect()
    want = [f"{f}{i}{p}" for f in "ab" for i in range(3) for p in ("", "+")] + [f"n{i:06d}" for i in range(n)] + ["zip", "zap"]
    assert [r["name"] for r in out] == want and len({r["seq"] for r in out}) == len(want)


@pytest.mark.parametrize("size", [1, 2, 7, 50])
def test_ranges_share_out_lines(size):
    raw = b"one\n\ntwo three\n" + b"x" * 40 + b"\nlast"
    want = [(m.start(), m.group()) for m in re.finditer(rb"[^\n]*(?=\n|$)", raw) if m.start() == 0 or raw[m.start() - 1 : m.start()] == b"\n"]
    got = [x for at in range(0, len(raw), size) for x in landing.lines_between(io.BytesIO(raw), at, at + size, 3)]
    assert got == want


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_any_number_of_begins_stay_open(spark, tmp_path):
    """300,000 open begins over two batches pair as the stack says."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    n, path = 300_000, f"file://{tmp_path}/in"
    base = spark.range(n).selectExpr("'t' trace_id", "id seq", "concat('n', id) name", "'' cat", "'B' ph", "'' cname", "'' id", "id ts", "0L dur", "1 pid", "1 tid", "'' args_json")
    ends = base.selectExpr("trace_id", f"seq + {n} seq", "name", "cat", "'E' ph", "cname", "id", f"ts + {n} ts", "dur", "pid", "tid", "args_json")
    for batch in (base, ends.where(f"seq < {2 * n - 10}")):
        batch.coalesce(1).write.mode("append").parquet(path)
        drained(streams.stream_pair_begin_end(spark.readStream.schema(streams.EVENT_SCHEMA).parquet(path)), tmp_path)
    out = spark.read.parquet(f"file://{tmp_path}/out")
    # The k-th end closes the k-th newest begin.
    assert out.count() == n - 10 and out.where(f"dur <> 2 * ({n} - 1 - ts) + 1").count() == 0
    assert out.agg(F.min("ts")).first()[0] == 10


def test_abandoned_begins_leave_by_a_timer(spark, tmp_path):
    """The watermark releases what is too old, also after a restart; the newer stay open."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    path = f"file://{tmp_path}/in"
    batches = [
        [event(1, "old", ph="B", ts=1_000_000), event(2, "older end", ph="X", ts=1_500_000)],
        [event(3, "young", ph="B", ts=9_000_000), event(4, "far", ph="X", ts=20_000_000, tid=2)],
        [event(5, ph="E", ts=21_000_000), event(6, ph="E", ts=22_000_000), event(7, "end", ph="X", ts=22_000_000)],
    ]
    for batch in batches:
        frame(spark, batch).coalesce(1).write.mode("append").parquet(path)
        drained(streams.stream_pair_begin_end(spark.readStream.schema(streams.EVENT_SCHEMA).parquet(path), abandon_us=15_000_000), tmp_path)
    got = {r["name"]: r["dur"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {"old": 0, "older end": 0, "far": 0, "young": 12_000_000, "end": 0}


def test_threads_with_nothing_open_ask_the_state_once():
    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *args: calls.append(name)

    class Handle:
        def getValueState(self, *args):
            return State()

        getMapState = getValueState

    stack = streams.OpenBegins()
    stack.init(Handle())
    given = pd.DataFrame([event(2, ph="E", ts=9), event(1, "a", ph="B", ts=4), event(3, "x", ts=5)], columns=list(EVENT_COLUMNS))
    out = pd.concat(stack.handleInputRows(("t", 1, 1), iter([given]), None))
    assert out[["seq", "name", "ph", "dur"]].values.tolist() == [[1, "a", "B", 5], [3, "x", "X", 0]]
    assert calls == ["exists"]
