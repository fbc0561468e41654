"""Stored events: clustered by time or thread, with a map of what each file holds that is read before any event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The map's folder in a store; readers of the events pass over names that begin so.
ZONES = "_zones"


def write_events(events: DataFrame, path: str, by: str = "thread", files: int | None = None, file_rows: int = 1 << 24) -> None:
    """Events as Parquet by trace, and a map of the files.

    They are dealt to ``files`` ranges (of Spark's own number unless given) from a sample, by thread and time, or by time
    alone (``by``), and sorted so in each file, whatever order they come in; a thread or an instant that is longer than a
    range goes on in the next. end_ts is stored too, so that both bounds of an interval prune row groups. The map has a
    row for each file and thread (``_zones``): first_ts, last_end, longest and events. Other columns, such as depths, are kept.
    """
    if by not in ("thread", "time"):
        raise ValueError(f"by thread or time, not {by!r}")
    order = ["trace_id", "pid", "tid", "ts"] if by == "thread" else ["trace_id", "ts"]
    number = files or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = events.withColumn("end_ts", F.col("ts") + F.col("dur")).repartitionByRange(number, *order).sortWithinPartitions(*order)
    held.write.option("maxRecordsPerFile", file_rows).partitionBy("trace_id").parquet(path)
    stored = events.sparkSession.read.parquet(path).select("trace_id", "pid", "tid", "ts", "end_ts", "dur", F.col("_metadata.file_path").alias("file"))
    zones = stored.groupBy("trace_id", "file", "pid", "tid").agg(F.min("ts").alias("first_ts"), F.max("end_ts").alias("last_end"), F.max("dur").alias("longest"), F.count("*").alias("events"))
    zones.write.parquet(f"{path.rstrip('/')}/{ZONES}")


def zones(spark: SparkSession, path: str) -> DataFrame:
    """The map of a store: trace_id, file, pid, tid, first_ts, last_end, longest, events."""
    return spark.read.parquet(f"{path.rstrip('/')}/{ZONES}")


def read_events(spark: SparkSession, path: str, t0: int | None = None, t1: int | None = None, threads: DataFrame | None = None, min_dur: int | None = None) -> DataFrame:
    """Stored events that meet [t0, t1], of ``threads`` (trace_id, pid, tid) alone if given, and of ``min_dur`` or longer if given.

    The map names the files that may hold any; only these are opened, and in them the row groups that the bounds leave.
    File names come to the driver, as they do where Spark lists a folder.
    """
    bounds = [(t0, "last_end", "end_ts", True), (t1, "first_ts", "ts", False), (min_dur, "longest", "dur", True)]
    bounds = [b for b in bounds if b[0] is not None]
    found, schema = zones(spark, path), spark.read.parquet(path).schema
    for bound, zone, _, least in bounds:
        found = found.where(F.col(zone) >= bound if least else F.col(zone) <= bound)
    wanted = None if threads is None else threads.select("trace_id", "pid", "tid").distinct()
    found = found if wanted is None else found.join(wanted, ["trace_id", "pid", "tid"], "left_semi")
    files = [r["file"] for r in found.select("file").distinct().collect()]
    opened = spark.read.schema(schema).option("basePath", path).parquet(*files) if files else spark.createDataFrame([], schema)
    for bound, _, row, least in bounds:
        opened = opened.where(F.col(row) >= bound if least else F.col(row) <= bound)
    return opened if wanted is None else opened.join(wanted, ["trace_id", "pid", "tid"], "left_semi")
