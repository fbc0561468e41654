"""Events from the driver's tables: spans, begins and ends, counters, thread names and long intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.sources.trace_files import from_table

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"
CATEGORY = "CASE WHEN event_type IN ('signup','purchase') THEN 'account' WHEN event_type = 'error' THEN 'fault' ELSE 'nav' END"
_SPANS = {
    "trace_id": "'t'",
    "seq": "event_id",
    "name": "event_type",
    "cat": CATEGORY,
    "ts": MICROS.format("ts"),
    "dur": "cast(round(value * 100) as bigint) * 6000000",
    "pid": "cast(user_id % 4 as int)",
    "tid": "cast(user_id as int)",
    "args_json": "props",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One complete span for each row of ``events``."""
    return from_table(_table(spark, sf_dir, "events"), _SPANS)


def begin_end_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as begins (view, click), ends (purchase, error) and points."""
    ph = "CASE WHEN event_type IN ('view','click') THEN 'B' WHEN event_type IN ('purchase','error') THEN 'E' ELSE 'X' END"
    return from_table(_table(spark, sf_dir, "events"), _SPANS | {"ph": ph, "dur": "cast(0 as bigint)"})


def counter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as counters with series k and value."""
    args = "concat('{\"k\":', get_json_object(props, '$.k'), ',\"value\":', value, '}')"
    return from_table(_table(spark, sf_dir, "events"), _SPANS | {"ph": "'C'", "dur": "cast(0 as bigint)", "args_json": args})


def thread_name_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata that names a thread after each customer; every tenth also has a sort index."""
    named = from_table(
        _table(spark, sf_dir, "customer"),
        {"trace_id": "'t'", "seq": "1000000000 + c_custkey", "name": "'thread_name'", "ph": "'M'", "pid": "cast(c_custkey % 4 as int)", "tid": "cast(c_custkey as int)", "args_json": "concat('{\"name\":\"', c_name, '\"}')"},
    )
    tenth = from_table(
        _table(spark, sf_dir, "customer").where("c_custkey % 10 = 0"),
        {"trace_id": "'t'", "seq": "2000000000 + c_custkey", "name": "'thread_sort_index'", "ph": "'M'", "pid": "cast(c_custkey % 4 as int)", "tid": "cast(c_custkey as int)", "args_json": "concat('{\"sort_index\":\"', -(c_custkey % 7), 'x\"}')"},
    )
    return named.unionByName(tenth)


def nation_name_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata that names a thread after each customer's nation, so that many bear the same name."""
    return from_table(
        _table(spark, sf_dir, "customer"),
        {"trace_id": "'t'", "seq": "1000000000 + c_custkey", "name": "'thread_name'", "ph": "'M'", "pid": "cast(c_custkey % 4 as int)", "tid": "cast(c_custkey as int)", "args_json": "concat('{\"name\":\"nation ', c_nationkey, '\"}')"},
    )


def full_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, counters (seq moved up) and thread names as one trace."""
    counters = counter_events(spark, sf_dir).withColumn("seq", F.col("seq") + 3_000_000_000)
    return span_events(spark, sf_dir).unionByName(counters).unionByName(thread_name_events(spark, sf_dir))


def line_item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long overlapping intervals: order to shipment of every line item, a thread for each supplier.

    seq is by order and line, and not unique where a table repeats these.
    """
    items = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = "unix_micros(cast(o_orderdate as timestamp))"
    numbered = items.selectExpr("l_orderkey", "l_linenumber", "l_suppkey", f"{start} as start", f"greatest(0, unix_micros(cast(l_shipdate as timestamp)) - {start}) as lasts")
    return from_table(
        numbered,
        {"trace_id": "'li'", "seq": "l_orderkey * 10 + l_linenumber", "name": "concat('line', l_linenumber)", "cat": "'ship'", "ts": "start", "dur": "lasts", "tid": "cast(l_suppkey as int)"},
    )
