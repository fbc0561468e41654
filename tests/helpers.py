from __future__ import annotations

from tracelark.operators.depth import call_depth, self_time
from tracelark.operators.normalize import assign_track

SCHEMA = "trace_id string, seq long, name string, cat string, ph string, cname string, id string, ts long, dur long, pid int, tid int, args_json string"


def event(seq, name="", cat="", ph="X", ts=0, dur=0, pid=1, tid=1, args="", id="", cname="", trace="t"):
    return (trace, seq, name, cat, ph, cname, id, ts, dur, pid, tid, args)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def nested(events):
    return self_time(call_depth(assign_track(events.where("ph <> 'M'"))))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
