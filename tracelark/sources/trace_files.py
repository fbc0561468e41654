"""Reading and writing trace files."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.operators.normalize import normalize_events
from tracelark.sources.json_ranges import byte_count, document_events, whole_file_bytes
from tracelark.sources.schema import EVENT_COLUMNS, RAW_FIELDS, RAW_STRUCT
from tracelark.sources.stored import read_events, write_events

def _placed(df: DataFrame) -> DataFrame:
    """Adds where each row's block is: _path and _start."""
    return df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))


def _in_files(events: DataFrame, paths: list[str], trace_id: str | None) -> DataFrame:
    """trace_id (the file, unless given), and seq made unique within it by the file's number in order of path."""
    if trace_id is None:
        return events.withColumnRenamed("_path", "trace_id")
    if len(paths) > 1:
        bits = 63 - (len(paths) - 1).bit_length()
        # Spark lists file:///a and names the same file file:/a in its metadata.
        named = [(re.sub("^([^:/]+):///", r"\1:/", path), k << bits) for k, path in enumerate(sorted(paths))]
        numbers = events.sparkSession.createDataFrame(named, "_path string, _file long")
        # Some 150 bytes a file: 15 MB at most are broadcast.
        events = events.join(F.broadcast(numbers) if len(paths) <= 100_000 else numbers, "_path").withColumn("seq", F.col("seq") + F.col("_file")).drop("_file")
    return events.drop("_path").withColumn("trace_id", F.lit(trace_id))


def _numbered(events: DataFrame, at: Column, paths: list[str], trace_id: str | None) -> DataFrame:
    """Adds trace_id and seq, unique within a trace, by file (in order of path), its block, and ``at``, the place there.

    seq needs no shuffle and is the same whenever the files are read in the same blocks. Its 63 bits are shared by the
    number of files; of a million files, a block may hold 2^24 events and a file 1 TB. More is an error, not a number twice.
    """
    conf = events.sparkSession.conf
    # Blocks begin at multiples of a size that is never below this one.
    least = max(1, min(byte_count(conf.get(f"spark.sql.files.{c}")) for c in ("maxPartitionBytes", "openCostInBytes")))
    for_files = (len(paths) - 1).bit_length()
    bits = min(33, 63 - for_files - max(1, 41 - least.bit_length()))
    block = F.floor(F.col("_start") / least).cast("long")
    fits = (at < (1 << bits)) & (block < (1 << (63 - for_files - bits)))
    place = F.when(fits, block * (1 << bits) + at).otherwise(F.raise_error(F.lit("too many events in a block, or too long a file, to number them")).cast("long"))
    return _in_files(events.withColumn("seq", place).drop("_start"), paths, trace_id)


def _row_in_partition() -> Column:
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)


def read_trace(spark: SparkSession, paths: str | Sequence[str], trace_id: str | None = None) -> DataFrame:
    """Events of whole JSON documents: an array of events, or an object whose ``traceEvents`` is one; or objects one after another.

    A document of any size is read in ranges by many tasks, whether or not it has line ends. Files that begin as gzip does
    are inflated, whatever their name, by one task each; corrupt gzip fails the job. What stands before a broken byte, or
    before the place where a file is cut off, is kept; an event that can't be read is dropped.
    """
    found, listed = document_events(spark, paths)
    event = F.from_json(F.col("value").cast("string"), RAW_STRUCT, {"allowUnquotedControlChars": "true"})
    # A generator, since a filter by fields of the struct itself would be moved below it and parse each event once more.
    read = _numbered(found, F.col("at"), listed, trace_id).select("trace_id", "seq", F.inline(F.array(event)))
    return normalize_events(read.where(F.coalesce(*RAW_FIELDS).isNotNull()))


def _line_events(value: str = "value"):
    """The events of a text line: those between the brackets and commas of an array, however many stand there; null if
    the line can't be read."""
    body = F.regexp_replace(value, r'^\s*(\{\s*"traceEvents"\s*:\s*)?\[?\s*,?', "")
    mild = F.regexp_replace(body, r"\s*,?\s*$", "")
    closed = F.regexp_replace(mild, r"\s*\]\s*\}?\s*$", "")
    # Other keys of the root object may follow the array.
    ended = F.regexp_replace(mild, r'(?s)(^|\})\s*\]\s*,\s*".*$', "$1")
    return F.coalesce(*(F.from_json(F.concat(F.lit("["), c, F.lit("]")), f"array<{RAW_STRUCT}>", {"allowUnquotedControlChars": "true"}) for c in (mild, closed, ended)))


def _parsed_lines(lines: DataFrame) -> DataFrame:
    """Events of text lines (trace_id, seq, value); the events of one line count on from its seq."""
    each = lines.select("trace_id", "seq", F.posexplode(_line_events()).alias("at", "e")).where("e is not null")
    return each.select("trace_id", (F.col("seq") + F.col("at")).alias("seq"), *(f"e.{f}" for f in RAW_FIELDS))


def read_trace_lines(spark: SparkSession, paths: str | Sequence[str], trace_id: str | None = None) -> DataFrame:
    """Events of files written line by line, as an array or an object around one; read in blocks by many tasks.

    A line may hold several events. One that can't be read is dropped, and no other: ``bad_lines`` counts these.
    """
    files = spark.read.text(paths)
    each = _placed(files).select("_path", "_start", F.explode(_line_events()).alias("e"))
    return normalize_events(_numbered(each, _row_in_partition(), files.inputFiles(), trace_id).where("e is not null").select("trace_id", "seq", "e.*"))


def bad_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """How many lines of each file ``read_trace_lines`` can't read: path, lines, bad."""
    lines = _placed(spark.read.text(paths)).select(F.col("_path").alias("path"), _line_events().isNull().alias("bad"))
    return lines.groupBy("path").agg(F.count("*").alias("lines"), F.count_if("bad").alias("bad"))


def read_gzip_trace(spark: SparkSession, paths: str | Sequence[str], trace_id: str | None = None) -> DataFrame:
    """``read_trace``, which looks into files of any name; kept for its callers."""
    return read_trace(spark, paths, trace_id)


def read_trace_pair(spark: SparkSession, baseline: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Two traces to compare, with trace_id baseline and target."""
    return read_trace(spark, baseline, "baseline"), read_trace(spark, target, "target")


def from_table(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Events from any table of intervals: ``mapping`` gives SQL expressions by event column; others are '' or 0."""
    empty = dict.fromkeys(EVENT_COLUMNS, "''") | {"seq": "cast(0 as bigint)", "ts": "cast(0 as bigint)", "dur": "cast(0 as bigint)", "pid": "0", "tid": "0", "ph": "'X'"}
    unknown = mapping.keys() - set(EVENT_COLUMNS)
    if unknown:
        raise ValueError(f"no such event columns: {sorted(unknown)}")
    return df.select(*(F.expr((empty | mapping)[c]).alias(c) for c in EVENT_COLUMNS))


def event_lines(events: DataFrame) -> DataFrame:
    """Events as JSON text lines, in the layout that ``read_trace_lines`` reads."""
    base = events.withColumn("_base", F.to_json(F.struct("name", "cat", "ph", "cname", "id", "ts", "dur", "pid", "tid")))
    spliced = F.concat(F.substr("_base", F.lit(1), F.length("_base") - 1), F.lit(',"args":'), F.col("args_json"), F.lit("}"))
    line = F.when(F.col("args_json") != "", spliced).otherwise(F.col("_base"))
    return base.select(F.concat(line, F.lit(",")).alias("value"))


def _documents(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A task's event lines as documents of at most about ``most`` bytes, a row each."""
    held, size = [], 0

    def document() -> pa.RecordBatch:
        text = '{"traceEvents":[\n' + "\n".join(held).removesuffix(",") + "\n]}"
        return pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["value"])

    for batch in batches:
        for line, length in zip(batch["value"].to_pylist(), pc.binary_length(batch["value"]).to_pylist(), strict=True):
            if held and size + length > most:
                yield document()
                held, size = [], 0
            held.append(line)
            size += length + 1
    if held:
        yield document()


def write_documents(events: DataFrame, path: str) -> None:
    """Events as JSON documents with ``traceEvents``, a file each, which ``read_trace`` reads: the events of a thread one after
    the other in order of seq, as many threads in a document as fit in what ``read_trace`` never cuts (4 MB at most), and
    long threads in several."""
    most = min(4 << 20, whole_file_bytes(events.sparkSession)) - 64
    threads = events.repartition("trace_id", "pid", "tid").sortWithinPartitions("trace_id", "pid", "tid", "seq")
    event_lines(threads).mapInArrow(lambda batches: _documents(batches, most), "value string").write.option("maxRecordsPerFile", 1).text(path)


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A result as parquet, json or csv."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"parquet, json or csv, not {fmt!r}")
    df.write.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


__all__ = ["bad_lines", "event_lines", "from_table", "read_events", "read_gzip_trace", "read_trace", "read_trace_lines", "read_trace_pair", "write_documents", "write_events", "write_report"]
