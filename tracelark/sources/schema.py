"""Schemas of trace events."""

from __future__ import annotations

#: Fields of a raw event as they stand in a file; numbers stay text until they are normalised.
RAW_FIELDS = ("name", "cat", "ph", "cname", "id", "ts", "dur", "pid", "tid", "args")
RAW_STRUCT = "struct<" + ",".join(f"{f}:string" for f in RAW_FIELDS) + ">"
#: Columns of the events table, in order.
EVENT_COLUMNS = ("trace_id", "seq", "name", "cat", "ph", "cname", "id", "ts", "dur", "pid", "tid", "args_json")
INT64 = (-(1 << 63), (1 << 63) - 1)
INT32 = (-(1 << 31), (1 << 31) - 1)
