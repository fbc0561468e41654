"""DuckDB SQL for the trace queries, over the driver's tables."""

from __future__ import annotations

DAY = 86_400_000_000
START = 1_704_067_200_000_000
MIDDLE = START + 15 * DAY
T0, T1 = START + 4 * DAY, START + 19 * DAY
CELL = 7_200_000_000

EV = """ev AS (
  SELECT event_id AS seq, event_type AS name,
    CASE WHEN event_type IN ('signup','purchase') THEN 'account' WHEN event_type = 'error' THEN 'fault' ELSE 'nav' END AS cat,
    'X' AS ph, epoch_us(ts) AS ts, CAST(round(value * 100) AS BIGINT) * 6000000 AS dur,
    CAST(user_id % 4 AS INTEGER) AS pid, CAST(user_id AS INTEGER) AS tid, props AS args_json,
    value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""
ORDERED = (
    EV
    + """, o AS (
  SELECT *, 'T:' || pid || ':' || tid AS track_id, ts + dur AS end_ts,
    CAST(row_number() OVER (PARTITION BY pid, tid ORDER BY ts, dur DESC, seq) AS INTEGER) AS ord FROM ev)"""
)
NESTED = (
    ORDERED
    + """, pairs AS (
  SELECT c.track_id, c.ord, p.ord AS p_ord, p.end_ts AS p_end FROM o c JOIN o p
    ON c.track_id = p.track_id AND p.ord < c.ord AND p.end_ts >= c.end_ts AND p.end_ts > c.ts),
lids AS (SELECT *, max(p_end) OVER (PARTITION BY track_id, ord ORDER BY p_ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lid FROM pairs),
found AS (SELECT track_id, ord, max(p_ord) AS parent_ord, count(*) AS depth FROM lids WHERE lid IS NULL OR p_end >= lid GROUP BY ALL),
n AS (SELECT o.*, found.parent_ord, CAST(coalesce(found.depth, 0) AS INTEGER) AS depth FROM o LEFT JOIN found USING (track_id, ord))"""
)
#: Thread names and sort indexes as they come from ``customer``.
NAMES = """names AS (
  SELECT CAST(c_custkey % 4 AS INTEGER) AS pid, CAST(c_custkey AS INTEGER) AS tid, c_name AS thread_name,
    CASE WHEN c_custkey % 10 = 0 THEN CAST(-(c_custkey % 7) AS INTEGER) END AS sort_index FROM customer)"""
TRACKS = (
    ORDERED
    + ", "
    + NAMES
    + """, threads AS (
  SELECT coalesce(e.pid, m.pid) AS pid, coalesce(e.tid, m.tid) AS tid, coalesce(thread_name, '') AS name,
    coalesce(sort_index, 0) AS sort_index, coalesce(event_count, 0) AS event_count, coalesce(max_dur, 0) AS max_dur
  FROM (SELECT pid, tid, count(*) AS event_count, max(dur) AS max_dur FROM ev GROUP BY ALL) e FULL JOIN names m ON e.pid = m.pid AND e.tid = m.tid),
ctracks AS (SELECT pid, name, count(*) AS event_count FROM ev GROUP BY ALL),
tr AS (
  SELECT 'T:' || pid || ':' || tid AS track_id, 'THREAD' AS track_type, pid, tid, name, '' AS id, sort_index, event_count, max_dur,
    CASE WHEN name <> '' THEN name ELSE 'Thread ' || tid END AS display_name FROM threads
  UNION ALL SELECT 'C:' || pid || ':' || length(name) || ':' || name || ':', 'COUNTER', pid, -1, name, '', 0, event_count, 0, name FROM ctracks),
tracks AS (
  SELECT *, CAST(row_number() OVER (ORDER BY sort_index, pid, CASE WHEN track_type = 'COUNTER' THEN 0 ELSE 1 END,
    CASE WHEN track_type = 'COUNTER' THEN lower(name) ELSE '' END, CASE WHEN track_type = 'COUNTER' THEN 0 ELSE tid END) AS INTEGER) AS track_order FROM tr)"""
)
BE = """be AS (
  SELECT event_id AS seq, event_type AS name, epoch_us(ts) AS ts, CAST(user_id % 4 AS INTEGER) AS pid, CAST(user_id AS INTEGER) AS tid,
    CASE WHEN event_type IN ('view','click') THEN 'B' WHEN event_type IN ('purchase','error') THEN 'E' ELSE 'X' END AS ph,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
sums AS (SELECT *, sum(CASE WHEN ph = 'B' THEN 1 ELSE -1 END) OVER (PARTITION BY tid ORDER BY seq) AS s FROM be WHERE ph <> 'X'),
mins AS (SELECT *, least(0, min(s) OVER (PARTITION BY tid ORDER BY seq)) AS m,
  coalesce(least(0, min(s) OVER (PARTITION BY tid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS pm FROM sums),
levels AS (SELECT *, s - m + CASE WHEN ph = 'B' THEN 0 ELSE 1 END AS level FROM mins WHERE ph = 'B' OR s >= pm),
ends AS (SELECT *, lead(ph) OVER w AS next_ph, lead(ts) OVER w AS next_ts, lead(k) OVER w AS next_k FROM levels WINDOW w AS (PARTITION BY tid, level ORDER BY seq)),
closed AS (SELECT seq, name, ph, ts, CASE WHEN next_ph = 'E' THEN greatest(0, next_ts - ts) ELSE 0 END AS dur, pid, tid, next_ph = 'E' AS matched, k, next_k FROM ends WHERE ph = 'B')"""
BOUNDS = "b AS (SELECT min(ts) AS lo, max(ts + dur) AS hi FROM ev)"


def _overlaps(source: str, n: int) -> str:
    return f"""{BOUNDS}, parts AS (SELECT i AS bucket, lo + i * ((hi - lo) / {n}) AS s, (hi - lo) / {n} AS w FROM b, range({n}) r(i)),
ov AS (SELECT bucket, name, w, least(ts + dur, s + w) - greatest(ts::DOUBLE, s) AS overlap FROM {source} JOIN parts ON ts < s + w AND ts + dur > s
  WHERE least(ts + dur, s + w) - greatest(ts::DOUBLE, s) > 0)"""


def _histogram(source: str) -> str:
    return f"""h AS (SELECT dur FROM {source}),
facts AS (SELECT min(dur) FILTER (dur > 0) AS low, max(dur) FILTER (dur > 0) AS high, count(*) FILTER (dur <= 0) AS zero FROM h),
shape AS (SELECT *, CASE WHEN high - low < 20 THEN high - low + 1 ELSE 20 END AS bins, high - low >= 20 AND high / low > 100 AS is_log, CASE WHEN zero > 0 THEN 1 ELSE 0 END AS first FROM facts),
edges AS (SELECT i, first, is_log, bins, CASE WHEN i = bins THEN high + 1
    WHEN is_log THEN CAST(floor(pow(10.0::DOUBLE, log10(low) + i * ((log10(high) - log10(low)) / bins)) + 0.5) AS BIGINT)
    ELSE low + (high - low) * i // bins END AS edge FROM shape, range(21) r(i) WHERE i <= bins),
bins AS (SELECT CAST(first + i AS INTEGER) AS bucket, edge AS min_dur, lead(edge) OVER (ORDER BY i) - 1 AS max_dur, is_log FROM edges),
buckets AS (SELECT * FROM bins WHERE max_dur IS NOT NULL UNION ALL SELECT 0, 0, 0, false FROM shape WHERE zero > 0),
hist AS (SELECT bucket, min_dur, max_dur, is_log, (SELECT count(*) FROM h WHERE CASE WHEN max_dur = 0 THEN dur <= 0 ELSE dur BETWEEN min_dur AND max_dur END) AS count FROM buckets)"""


IN_WINDOW = f"ts >= {T0} AND ts <= {T1}"
MEETS_WINDOW = f"ts + dur >= {T0} AND ts <= {T1}"
DIFF = """a AS (SELECT {key} AS key, sum(dur) AS dur, count(*) AS c FROM {base} GROUP BY 1),
t AS (SELECT {key} AS key, sum(dur) AS dur, count(*) AS c FROM {target} GROUP BY 1),
d AS (SELECT coalesce(a.key, t.key) AS key, coalesce(a.dur, 0)::BIGINT AS base_dur, coalesce(a.c, 0) AS base_count, coalesce(t.dur, 0)::BIGINT AS target_dur, coalesce(t.c, 0) AS target_count
  FROM a FULL JOIN t ON a.key = t.key),
diff AS (SELECT *, target_dur - base_dur AS delta_dur, target_count - base_count AS delta_count FROM d)"""
LINES = """li AS (
  SELECT l_orderkey * 10 + l_linenumber AS seq, 'line' || l_linenumber AS name, CAST(l_suppkey AS INTEGER) AS tid,
    epoch_us(o_orderdate::TIMESTAMP) AS ts, greatest(0, epoch_us(l_shipdate::TIMESTAMP) - epoch_us(o_orderdate::TIMESTAMP)) AS dur
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LINES_NESTED = (
    LINES
    + """, o AS (SELECT *, ts + dur AS end_ts, row_number() OVER (PARTITION BY tid ORDER BY ts, dur DESC, seq) AS ord FROM li),
pairs AS (SELECT c.tid, c.ord, p.ord AS p_ord, p.end_ts AS p_end FROM o c JOIN o p ON c.tid = p.tid AND p.ord < c.ord AND p.end_ts >= c.end_ts AND p.end_ts > c.ts),
lids AS (SELECT *, max(p_end) OVER (PARTITION BY tid, ord ORDER BY p_ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lid FROM pairs),
found AS (SELECT tid, ord, count(*) AS depth FROM lids WHERE lid IS NULL OR p_end >= lid GROUP BY ALL),
n AS (SELECT o.*, CAST(coalesce(depth, 0) AS INTEGER) AS depth FROM o LEFT JOIN found USING (tid, ord))"""
)
PROBES = f"probes AS (SELECT o_orderkey AS probe_id, {START} + o_orderkey * 60000000 % (30 * {DAY}) AS \"at\" FROM orders)"
COUNTERS = (
    EV
    + """, c AS (SELECT *, 'C:' || pid || ':' || length(name) || ':' || name || ':' AS track_id,
  row_number() OVER (PARTITION BY pid, name ORDER BY ts, seq) AS ord FROM ev)"""
)
PEAKS = (
    COUNTERS
    + f""", spans AS (SELECT track_id, min(ts) AS first_ts, max(ts) AS last_ts FROM c GROUP BY 1),
cells0 AS (SELECT *, greatest({T0 // CELL}, first_ts // {CELL}) AS c0, CAST(ceil({T1} / {CELL}) AS BIGINT) - 1 AS c1 FROM spans WHERE {T1} > first_ts AND {T0} < last_ts),
cells1 AS (SELECT track_id, first_ts, last_ts, c0, least(c1, greatest(CAST(ceil(last_ts / {CELL}) AS BIGINT) - 1, c0)) AS c1 FROM cells0),
v AS (SELECT track_id, ord, ts // {CELL} AS cell, 'k' AS series, k AS num FROM c UNION ALL SELECT track_id, ord, ts // {CELL}, 'value', value FROM c),
spine AS (SELECT track_id, first_ts, last_ts, c0, series, unnest(range(c0, c1 + 1)) AS cell FROM cells1, (VALUES ('k'), ('value')) s(series)),
inside AS (SELECT track_id, series, cell, max(num) AS top, max_by(num, ord) AS last FROM v GROUP BY ALL),
carried AS (SELECT s.track_id, v.series, max_by(num, ord) AS carried FROM cells1 s JOIN v ON v.track_id = s.track_id AND v.cell < c0 GROUP BY ALL),
filled AS (SELECT spine.*, top, last, carried FROM spine LEFT JOIN inside USING (track_id, series, cell) LEFT JOIN carried USING (track_id, series)),
peaks AS (SELECT track_id, cell, series, greatest(cell * {CELL}, first_ts, {T0}) AS start_ts, least((cell + 1) * {CELL}, last_ts, {T1}) AS end_ts,
  coalesce(top, last_value(last IGNORE NULLS) OVER (PARTITION BY track_id, series ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), carried, 0) AS peak FROM filled),
shown AS (SELECT * FROM peaks WHERE end_ts > start_ts)"""
)
BLOCKS = (
    NESTED
    + f""", seen AS (SELECT *, CASE WHEN ts >= {T0 // CELL * CELL} THEN ts // {CELL} END AS cell, ts < {T0 // CELL * CELL} OR dur >= {CELL} AS kept FROM n
  WHERE (ts BETWEEN {T0 // CELL * CELL} AND {T0 // CELL * CELL + -(-(T1 - T0 // CELL * CELL) // CELL) * CELL - 1}) OR (ts < {T0 // CELL * CELL} AND ts + dur > {T0})),
flagged AS (SELECT *, max(CASE WHEN kept THEN end_ts END) OVER w AS covered, max(CASE WHEN kept THEN cell END) OVER w AS taken FROM seen
  WINDOW w AS (PARTITION BY track_id, depth ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
small AS (SELECT * FROM flagged WHERE NOT kept AND NOT coalesce(covered >= (cell + 1) * {CELL}, false) AND NOT coalesce(taken = cell, false))"""
)
_X = f"WITH {EV} "
_N = f"WITH {NESTED} "
_T = f"WITH {TRACKS} "
_HEAT = "cells AS (SELECT track_id, CAST(greatest(0, least({n} - 1, floor((ts - lo) / ((hi - lo) / {n})))) AS INTEGER) AS bucket, max_by(struct_pack(seq, name, dur), struct_pack(d := dur, o := -ord)) AS best, count(*) AS hits FROM n, b WHERE depth = 0 GROUP BY ALL)"

ORACLES = {
    "s1_read_trace": _X + "SELECT row_number() OVER (PARTITION BY tid ORDER BY seq)::INTEGER AS rank, name, cat, ts, dur, pid, tid FROM ev",
    "s2_read_trace_lines": _X + "SELECT row_number() OVER (PARTITION BY tid ORDER BY seq)::INTEGER AS rank, name, cat, ph, ts, dur, pid, tid, replace(args_json, ' ', '') AS args_json FROM ev",
    "s3_read_gzip": _X + "SELECT row_number() OVER (PARTITION BY tid ORDER BY seq)::INTEGER AS rank, name, ts, dur, pid, tid FROM ev",
    "s4_read_trace_pair": f"WITH {LINES}, e AS (SELECT * FROM li WHERE tid % 2 = 0), o AS (SELECT * FROM li WHERE tid % 2 = 1), {DIFF.format(key='name', base='e', target='o')} SELECT * FROM diff",
    "s5_from_table": _X + "SELECT seq, name, cat, ph, ts, dur, pid, tid, args_json FROM ev",
    "s6_write_report": _X + "SELECT name AS key, sum(dur)::BIGINT AS total_dur, count(*) AS count FROM ev GROUP BY 1",
    "s7_write_events": _X + f"SELECT seq, name, ts, dur FROM ev WHERE {MEETS_WINDOW}",
    "p1_normalize": _X + "SELECT seq, ts, dur * 100 AS dur, -pid AS pid, CAST(least(tid::BIGINT * 10000000000, 2147483647) AS INTEGER) AS tid FROM ev",
    "p2_pair_begin_end": f"WITH {BE} SELECT seq, name, ph, ts, dur::BIGINT AS dur, pid, tid FROM closed UNION ALL SELECT seq, name, ph, ts, 0, pid, tid FROM be WHERE ph = 'X'",
    "p3_merge_args": f"WITH {BE} SELECT seq, 'b' AS key, 1.0::DOUBLE AS num FROM closed UNION ALL SELECT seq, 'k', CASE WHEN matched THEN next_k ELSE k END FROM closed",
    "p4_parse_args": _X + "SELECT seq, unnest(['k', 's', 't', 'n']) AS key, unnest(['', name, 'true', 'null']) AS str, unnest([k, 0.0, 0.0, 0.0]) AS num FROM ev",
    "p5_assign_track": _T + "SELECT track_type, track_id, event_count + CASE WHEN track_type = 'THREAD' AND name <> '' THEN CASE WHEN tid % 10 = 0 THEN 2 ELSE 1 END ELSE 0 END AS events FROM tracks",
    "p6_display_name": _T + "SELECT track_id, display_name FROM tracks",
    "f1_match_text": _X + "SELECT seq, name, cat FROM ev WHERE contains(lower(name), 'nav') OR contains(lower(cat), 'nav')",
    "f2_search": "SELECT 1000000000 + c_custkey AS seq, 'thread_name' AS name, 'M' AS ph FROM customer WHERE contains(c_name, '#00000001')",
    "f3_overlaps": _X + f"SELECT seq, ts, dur FROM ev WHERE {MEETS_WINDOW}",
    "f4_starts_in": _X + f"SELECT seq, ts, dur FROM ev WHERE {IN_WINDOW}",
    "f5_max_depth": _N + "SELECT seq, depth FROM n WHERE depth <= 1",
    "f6_on_track": _T + "SELECT seq, o.name, ts FROM o WHERE track_id = (SELECT min_by(track_id, track_order) FROM tracks WHERE name = 'Customer#000000008')",
    "f7_on_tracks_named": _X + "SELECT seq, name, ts FROM ev WHERE (tid, pid) IN (SELECT (c_custkey::INTEGER, (c_custkey % 4)::INTEGER) FROM customer WHERE c_nationkey = 7)",
    "f8_min_count": _X + ", g AS (SELECT tid, count(*) AS c FROM ev GROUP BY 1) SELECT count(*) FILTER (c >= 70) AS kept, count(*) FILTER (c < 70) AS skipped, (sum(c) FILTER (c >= 70))::BIGINT AS kept_events FROM g",
    "f9_bucket_filter": f"WITH {EV}, {_histogram('ev')} SELECT seq, ev.dur FROM ev JOIN hist ON bucket = 12 AND ev.dur BETWEEN min_dur AND max_dur",
    "f10_region_select": _N + f"SELECT seq, ts, depth FROM n WHERE pid = 1 AND depth BETWEEN 0 AND 1 AND {MEETS_WINDOW}",
    "j1_diff": f"WITH {EV}, e1 AS (SELECT * FROM ev WHERE ts < {MIDDLE}), e2 AS (SELECT * FROM ev WHERE ts >= {MIDDLE}), {DIFF.format(key='name', base='e1', target='e2')} SELECT * FROM diff",
    "j2_resolve_parents": _N + "SELECT track_id, ord, parent_ord FROM n WHERE parent_ord IS NOT NULL",
    "j3_children_of": _N + "SELECT c.track_id, c.parent_ord, p.name AS parent_name, c.ord, c.name, c.dur FROM n c JOIN n p ON c.track_id = p.track_id AND c.parent_ord = p.ord",
    "j4_bucket_overlap": f"WITH {EV}, {_overlaps('ev', 50)} SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS events, round(sum(overlap), 0) AS overlap FROM ov GROUP BY 1",
    "j5_attach_track": _T + "SELECT seq, display_name, track_order FROM o JOIN tracks USING (track_id)",
    "j6_track_names": f"WITH {NAMES} SELECT pid, tid, thread_name, sort_index FROM names",
    "j7_tracks_with_hits": _T + "SELECT track_id, track_id IN (SELECT track_id FROM o WHERE contains(lower(name), 'signup')) AS has_hit FROM tracks",
    "j8_events_at": _X + f", {PROBES} SELECT probe_id, count(*) AS events, min(seq) AS first, max(seq) AS last FROM ev JOIN probes ON ts <= \"at\" AND \"at\" < ts + dur GROUP BY 1",
    "j9_nearest_edge": _X + f""", {PROBES}, edges AS (SELECT DISTINCT unnest([ts, ts + dur]) AS e FROM ev),
before AS (SELECT probe_id, "at", e AS be FROM probes ASOF LEFT JOIN edges ON "at" >= e),
both_ AS (SELECT before.*, e AS ae FROM before ASOF LEFT JOIN edges ON "at" <= e),
pick AS (SELECT probe_id, "at", CASE WHEN ae IS NULL OR "at" - be <= ae - "at" THEN be ELSE ae END AS e FROM both_)
SELECT probe_id, "at", CASE WHEN abs("at" - e) < 300000000 THEN e END AS edge, CASE WHEN abs("at" - e) < 300000000 THEN abs("at" - e) END AS distance FROM pick""",
    "j10_inspect": _N + """, me AS (SELECT * FROM n WHERE pid = 0 AND tid = 8)
SELECT m.seq, m.name, m.ts, m.dur, (m.dur - coalesce((SELECT sum(dur) FROM me c WHERE c.parent_ord = m.ord), 0))::BIGINT AS self_dur, m.depth,
  (SELECT p.name FROM me p WHERE p.ord = m.parent_ord) AS parent_name, (SELECT count(*) FROM me c WHERE c.parent_ord = m.ord)::INTEGER AS children
FROM me m WHERE m.ts = (SELECT min(ts) FROM me)""",
    "a1_aggregate_by_name": _X + "SELECT name AS key, sum(dur)::BIGINT AS total_dur, count(*) AS count FROM ev GROUP BY 1",
    "a1_aggregate_by_category": _X + "SELECT cat AS key, sum(dur)::BIGINT AS total_dur, count(*) AS count FROM ev GROUP BY 1",
    "a2_aggregate_report": _X + "SELECT name AS key, sum(dur)::BIGINT AS total_dur, round(sum(dur) / 1e6, 6) AS total_s, count(*) AS count, round(sum(dur) / count(*) / 1e3, 6) AS average_ms FROM ev GROUP BY 1 HAVING count(*) >= 2",
    "a3_summary": _T + "SELECT 2 * (SELECT count(*) FROM ev) + (SELECT count(*) + count(sort_index) FROM names) AS event_count, (SELECT count(*) FROM tracks) AS track_count, min(ts) AS min_ts, max(ts + dur) AS max_ts, round((max(ts + dur) - min(ts)) / 1e3, 6) AS duration_ms FROM ev",
    "a4_organize_tracks": f"WITH {NESTED}, {TRACKS.split('FROM ev), ', 1)[1]}, deep AS (SELECT track_id, max(depth) AS d FROM n GROUP BY 1) SELECT tracks.track_id, track_type, pid, tid, name, id, sort_index, event_count, max_dur, coalesce(d, 0) AS max_depth, track_order FROM tracks LEFT JOIN deep USING (track_id)",
    "a5_list_tracks": _T + "SELECT track_order - 1 AS index, display_name AS name, track_type AS type, pid, tid, event_count AS events FROM tracks",
    "a6_histogram": f"WITH {EV}, {_histogram('ev')} SELECT bucket, min_dur, max_dur, count, is_log FROM hist",
    "a7_histogram_report": f"WITH {EV}, f AS (SELECT * FROM ev WHERE cat = 'nav' AND {IN_WINDOW}), {_histogram('f')}, t AS (SELECT sum(count) AS total, min_by(max_dur - min_dur, bucket) AS fw, max_by(max_dur - min_dur, bucket) AS lw FROM hist)\n"
    "SELECT bucket, count, round(count / total * 100, 6) AS percent, CAST(greatest(0, least(20, trunc(count / total * 100 / 100 * 20))) AS INTEGER) AS bar, CASE WHEN lw > fw * 2 THEN 'logarithmic' ELSE 'linear' END AS scale_label FROM hist, t",
    "a8_concurrency": f"WITH {NESTED}, top AS (SELECT * FROM n WHERE depth = 0), {_overlaps('top', 16)}, busy AS (SELECT bucket, sum(overlap / w) AS c FROM ov GROUP BY 1),\n"
    "doms AS (SELECT bucket, name, row_number() OVER (PARTITION BY bucket ORDER BY sum(overlap) DESC, name) AS rank FROM ov GROUP BY 1, 2),\n"
    "dom AS (SELECT bucket, string_agg(name, ',' ORDER BY rank) AS dominant FROM doms WHERE rank <= 3 GROUP BY 1), th AS (SELECT count(DISTINCT tid) AS threads FROM ev)\n"
    "SELECT CAST(p.bucket AS INTEGER) AS bucket, round(s, 0) AS start_ts, round(coalesce(c, 0), 6) AS concurrency, round(coalesce(c, 0) / threads * 100, 4) AS percent,\n"
    "CAST(greatest(0, least(20, trunc(coalesce(c, 0) / threads * 20))) AS INTEGER) AS bar, coalesce(dominant, '') AS dominant FROM parts p LEFT JOIN busy USING (bucket) LEFT JOIN dom USING (bucket), th",
    "a9_dominant_events": f"WITH {NESTED}, top AS (SELECT * FROM n WHERE depth = 0), {_overlaps('top', 16)}, r AS (SELECT CAST(bucket AS INTEGER) AS bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY sum(overlap) DESC, name) AS INTEGER) AS rank, name, round(sum(overlap), 0) AS overlap FROM ov GROUP BY bucket, name) SELECT * FROM r WHERE rank <= 3",
    "a10_heatmap": f"WITH {NESTED}, {BOUNDS}, {_HEAT.format(n=16)} SELECT track_id, bucket, best.seq AS seq, best.name AS name, best.dur AS dur, hits FROM cells",
    "a11_counter_series": f"WITH {COUNTERS} SELECT DISTINCT track_id, 'k,value' AS series FROM c",
    "a12_counter_max_total": f"WITH {COUNTERS} SELECT track_id, round(greatest(0, max(k + value)), 6) AS max_total FROM c GROUP BY 1",
    "a13_self_time": _N + ", spent AS (SELECT track_id, parent_ord AS ord, sum(dur) AS s FROM n WHERE parent_ord IS NOT NULL GROUP BY ALL) SELECT seq, depth, (dur - coalesce(s, 0))::BIGINT AS self_dur FROM n LEFT JOIN spent USING (track_id, ord)",
    "a14_track_stats": f"WITH {ORDERED} SELECT track_id, CAST((ord - 1) // 16 AS BIGINT) AS block, max(dur) AS max_dur, count(*) AS events FROM o GROUP BY 1, 2",
    "a15_counter_totals": f"WITH {COUNTERS} SELECT seq, unnest(['value', 'k', 'Total']) AS label, round(unnest([value, k, value + k]), 6) AS value FROM c",
    "w1_track_order": f"WITH {ORDERED} SELECT seq, track_id, ord FROM o",
    "w2_call_depth": _N + "SELECT seq, ord, depth, parent_ord FROM n",
    "w2_call_depth_long": f"WITH {LINES_NESTED} SELECT tid, depth, count(*) AS events, sum(dur)::BIGINT AS total_dur FROM n GROUP BY 1, 2",
    "w2_call_depth_slices": f"WITH {LINES_NESTED} SELECT tid, depth, count(*) AS events, sum(dur)::BIGINT AS total_dur FROM n GROUP BY 1, 2",
    "w3_quiescent_segments": f"WITH {ORDERED}, m AS (SELECT *, max(end_ts) OVER (PARTITION BY track_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM o) SELECT track_id, count(*) FILTER (ts >= until) AS segments, max(end_ts) AS last_end FROM m GROUP BY 1",
    "w4_downsample_timeline": f"WITH {BLOCKS} SELECT track_id, depth, ts AS start_ts, greatest(end_ts, ts + {CELL}) AS end_ts, 1::BIGINT AS count, seq, name FROM flagged WHERE kept\n"
    f"UNION ALL SELECT track_id, depth, cell * {CELL}, (cell + 1) * {CELL}, count(*), max_by(seq, struct_pack(d := dur, o := -ord)), max_by(name, struct_pack(d := dur, o := -ord)) FROM small GROUP BY track_id, depth, cell",
    "w5_downsample_counters": f"WITH {PEAKS} SELECT track_id, cell, start_ts, end_ts, series, round(peak, 6) AS peak FROM shown",
    "w6_stack_series": f"WITH {PEAKS}, st AS (SELECT *, sum(peak) OVER (PARTITION BY track_id, cell ORDER BY series) AS high FROM shown) SELECT track_id, cell, series, round(high - peak, 6) AS low, round(high, 6) AS high FROM st",
    "w7_coalesce_runs": f"WITH {NESTED}, {BOUNDS}, {_HEAT.format(n=64)}, g AS (SELECT track_id, bucket, best.name AS name, CASE WHEN lag(best.name) OVER w = best.name AND lag(bucket) OVER w = bucket - 1 THEN 0 ELSE 1 END AS brk FROM cells WINDOW w AS (PARTITION BY track_id ORDER BY bucket)),\n"
    "r AS (SELECT *, sum(brk) OVER (PARTITION BY track_id ORDER BY bucket) AS run FROM g) SELECT track_id, min(bucket) AS first, max(bucket) AS last, any_value(name) AS name FROM r GROUP BY track_id, run",
    "w8_hottest_track_window": _T + ", s AS (SELECT track_order, sum(event_count) OVER w AS total, count(*) OVER w AS width FROM tracks WINDOW w AS (ORDER BY track_order ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING)), best AS (SELECT track_order AS f FROM s WHERE width = 25 ORDER BY total DESC, track_order LIMIT 1) SELECT track_id, track_order, event_count FROM tracks, best WHERE track_order BETWEEN f AND f + 24",
    "t1_query_events": f"WITH {NESTED}, {TRACKS.split('FROM ev), ', 1)[1]} SELECT seq, n.name, ts, dur, track_order FROM n JOIN tracks USING (track_id) WHERE cat = 'nav' AND depth = 0 AND {MEETS_WINDOW} ORDER BY ts, track_order, ord LIMIT 200",
    "t2_sort_results": _X + "SELECT seq, dur FROM ev WHERE name = 'error'",
    "t3_top_names_per_bucket": f"WITH {EV}, {_overlaps('ev', 60)}, r AS (SELECT CAST(bucket AS INTEGER) AS bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY sum(overlap) DESC, name) AS INTEGER) AS rank, name, round(sum(overlap), 0) AS overlap FROM ov GROUP BY bucket, name) SELECT * FROM r WHERE rank <= 3",
    "t4_order_tracks": _T + "SELECT track_id, sort_index, track_order FROM tracks",
    "t5_diff_order": f"WITH {EV}, e1 AS (SELECT * FROM ev WHERE ts < {MIDDLE}), e2 AS (SELECT * FROM ev WHERE ts >= {MIDDLE}), {DIFF.format(key='cat', base='e1', target='e2')} SELECT key, delta_dur, delta_count FROM diff",
    "c1_contains": _X + "SELECT seq, contains(lower(name), 'chas') AS found, true AS every FROM ev",
    "c3_nice_interval": _X + ", r AS (SELECT seq, dur / 12.0::DOUBLE AS raw FROM ev), p AS (SELECT seq, raw, pow(10.0::DOUBLE, floor(log10(raw))) AS pw FROM r WHERE raw > 0)\n"
    "SELECT seq, greatest(1.0::DOUBLE, pw * CASE WHEN raw / pw < 1.5 THEN 1 WHEN raw / pw < 3.5 THEN 2 WHEN raw / pw < 7.5 THEN 5 ELSE 10 END) AS step FROM p UNION ALL SELECT seq, 1.0 FROM r WHERE raw <= 0",
    "c4_bar_chars": _X + ", c AS (SELECT seq, CAST(greatest(0, least(20, trunc(dur / 6e8::DOUBLE / 3 / 100 * 20))) AS INTEGER) AS cells FROM ev) SELECT seq, cells, repeat('█', cells) || repeat('░', 20 - cells) AS bar FROM c",
    "c5_leading_integer": _X + "SELECT seq, CASE WHEN seq % 3 = 0 THEN -tid ELSE tid END AS number, 0 AS none FROM ev",
    "c6_units": _X + "SELECT seq, dur / 1e3 AS ms, dur / 1e6 AS s FROM ev",
    "c7_arg_lookup": _X + "SELECT seq, k, NULL::DOUBLE AS z FROM ev",
    "st1_stream_events": _X + "SELECT name, cat, ts, dur, pid, tid FROM ev",
    "st2_stream_pair": f"WITH {BE} SELECT seq, name, ph, ts, dur::BIGINT AS dur FROM closed WHERE matched UNION ALL SELECT seq, name, ph, ts, 0 FROM be WHERE ph = 'X'",
    "st3_stream_totals": _X + "SELECT name AS key, count(*) AS count, sum(dur)::BIGINT AS total_dur, min(ts) AS min_ts, max(ts + dur) AS max_ts FROM ev GROUP BY 1",
    "p7_color_class": _X
    + ", h AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 'rail_load' ELSE '' END AS cname, CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(name, ''), lambda c: ord(c)::UBIGINT)),\n"
    "  lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 8 AS INTEGER) AS slot FROM ev), c AS (SELECT name, cname, CASE WHEN cname = 'rail_load' THEN 1 ELSE slot END AS slot FROM h)\n"
    "SELECT name, cname, min(slot) AS low, max(slot) AS high, count(*) AS events FROM c GROUP BY 1, 2",
    "a16_auto_bin_counts": _X
    + ", f AS (SELECT (max(ts) - min(ts)) / 30 AS raw FROM ev), p AS (SELECT raw, pow(10.0::DOUBLE, floor(log10(raw))) AS pw FROM f),\n"
    "w AS (SELECT CAST(greatest(1, pw * CASE WHEN raw / pw < 1.5 THEN 1 WHEN raw / pw < 3.5 THEN 2 WHEN raw / pw < 7.5 THEN 5 ELSE 10 END) AS BIGINT) AS width FROM p)\n"
    "SELECT ts // width * width AS bin_start, count(*) AS count FROM ev, w GROUP BY 1",
    "c2_format_duration": _X
    + ", u AS (SELECT seq, dur / 7 AS us FROM ev), v AS (SELECT seq, us, CASE WHEN us >= 1e6 THEN us / 1e6 WHEN us >= 1e3 THEN us / 1e3 ELSE us END AS own,\n"
    "  CASE WHEN us >= 1e6 THEN 's' WHEN us >= 1e3 THEN 'ms' ELSE 'us' END AS unit FROM u)\n"
    "SELECT seq, CASE WHEN us = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.2f', own), '0+$', ''), '[.]$', '') || ' ' || unit END AS shown,\n"
    "  CASE WHEN us = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.2f', us / 1e3), '0+$', ''), '[.]$', '') || ' ms' END AS in_ms FROM v",
}
ORACLES["j8_events_at_all"] = ORACLES["j8_events_at"]
ORACLES["j9_nearest_edge_all"] = ORACLES["j9_nearest_edge"]
ORACLES["w4_downsample_stored"] = ORACLES["w4_downsample_timeline"]
