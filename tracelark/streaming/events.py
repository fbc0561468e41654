"""Traces as they arrive: events, spans across batches, and running totals."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelark.operators.normalize import normalize_events
from tracelark.operators.pairing import THREAD
from tracelark.sources.schema import EVENT_COLUMNS
from tracelark.sources.trace_files import _parsed_lines
from tracelark.streaming import landing

_TYPES = {"seq": "bigint", "ts": "bigint", "dur": "bigint", "pid": "int", "tid": "int"}
_SEQ, _PH, _TS, _DUR = (EVENT_COLUMNS.index(c) for c in ("seq", "ph", "ts", "dur"))
EVENT_SCHEMA = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in EVENT_COLUMNS)


def stream_events(spark: SparkSession, folder: str, trace_id: str | None = None, log: str | None = None, range_bytes: int = landing.RANGE_BYTES) -> DataFrame:
    """Events of line files as they land in ``folder``; each file, one write's share of a trace, is read in ranges by many tasks.

    seq follows the order in which files landed, kept in ``log`` (``_landing`` in the folder unless given; one stream writes
    there), then the place in the file: it is unique whenever files land, and the same after a restart. ``folder`` is a
    URI that pyarrow can open where the tasks run, and files are whole when they appear.
    """
    spark.dataSource.register(landing.LandedLines)
    lines = spark.readStream.format("landed_lines").option("rangeBytes", str(range_bytes))
    lines = (lines.option("log", log) if log else lines).load(folder)
    named = lines.select((F.lit(trace_id) if trace_id else F.col("path")).alias("trace_id"), "seq", F.col("value").cast("string").alias("value"))
    return normalize_events(_parsed_lines(named))


class OpenBegins(StatefulProcessor):
    """The stack of open begins of one thread, kept between batches; a begin is given out when its end comes.

    The stack lies in pages of the state, of which a batch reads those that its ends reach. With ``abandon_us``, a timer
    gives out the oldest begins, with duration 0, once the watermark is so far behind their start.
    """

    def __init__(self, abandon_us: int | None = None, page_rows: int = 1024):
        self.abandon_us, self.page_rows = abandon_us, page_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "low long, high long")
        self.pages = handle.getMapState("pages", "page long", "rows binary")

    def _load(self) -> None:
        # Each look into the state is a call to the JVM, for every thread: none is made for what can't be there.
        self.known = self.ends.exists()
        self.low, self.high = self.ends.get() if self.known else (0, 0)
        self.stored = set(range(self.low // self.page_rows, -(-self.high // self.page_rows))) if self.high > self.low else set()
        self.read: dict[int, list] = {}
        self.changed: set[int] = set()

    def _page(self, page: int) -> list:
        if page not in self.read:
            self.read[page] = pickle.loads(self.pages.getValue((page,))[0]) if page in self.stored else []
        return self.read[page]

    def _push(self, event: tuple) -> None:
        page, at = divmod(self.high, self.page_rows)
        rows = self._page(page)
        del rows[at:]
        rows.append(event)
        self.changed.add(page)
        self.high += 1
        if len(self.changed) > 64:  # what a batch opens doesn't pile up here
            self._store(page)

    def _pop(self) -> tuple:
        self.high -= 1
        page, at = divmod(self.high, self.page_rows)
        return self._page(page)[at]

    def _store(self, keep: int | None = None) -> None:
        for page in sorted(self.changed):
            if page != keep:
                first = page * self.page_rows
                if first < self.high and first + self.page_rows > self.low:
                    self.pages.updateValue((page,), (pickle.dumps(self._page(page)[: self.high - first], 5),))
                    self.stored.add(page)
                    self.read.pop(page)
                    self.changed.discard(page)

    def _save(self, before: tuple[int, int]) -> None:
        self._store()
        kept = range(self.low // self.page_rows, -(-self.high // self.page_rows) if self.high > self.low else self.low // self.page_rows)
        for page in sorted(self.stored):
            if page not in kept:
                self.pages.removeKey((page,))
        if self.high > self.low:
            if (self.low, self.high) != before:
                self.ends.update((self.low, self.high))
        elif self.known:
            self.ends.clear()

    def _set_timer(self) -> None:
        """One timer a thread: for its oldest open begin."""
        if self.abandon_us is not None and self.high > self.low:
            page, at = divmod(self.low, self.page_rows)
            due = -(-(self._page(page)[at][_TS] + self.abandon_us) // 1000)
            if due not in set(self.handle.listTimers()):
                self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # Tuples, sorted as such: a thread often has few rows, on which each step of pandas takes longer than all of them.
        events = [event for frame in rows for event in zip(*(frame[c].tolist() for c in EVENT_COLUMNS), strict=True)]
        events.sort(key=itemgetter(_SEQ))
        self._load()
        before = (self.low, self.high)
        done: list[tuple] = []
        for event in events:
            if event[_PH] in ("B", "b"):
                self._push(event)
            elif event[_PH] in ("E", "e"):
                if self.high > self.low:
                    begin = list(self._pop())
                    begin[_DUR] = max(0, event[_TS] - begin[_TS])
                    done.append(tuple(begin))
            else:
                done.append(event)
        self._set_timer()
        self._save(before)
        if done:
            yield pd.DataFrame(done, columns=list(EVENT_COLUMNS))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self._load()
        before, done, now = (self.low, self.high), [], timerValues.getCurrentWatermarkInMs() * 1000
        while self.high > self.low:
            page, at = divmod(self.low, self.page_rows)
            begin = self._page(page)[at]
            if begin[_TS] + self.abandon_us > now:
                break
            done.append(begin)
            self.low += 1
        self._set_timer()
        self._save(before)
        yield pd.DataFrame(done, columns=list(EVENT_COLUMNS))

    def close(self) -> None:
        pass


def stream_pair_begin_end(events: DataFrame, abandon_us: int | None = None) -> DataFrame:
    """Spans from a stream of events, each when its end has come; other events pass.

    A thread may keep any number of begins open: its stack lies in pages of the state. Begins still open when the stream stops
    stay there. With ``abandon_us``, a begin whose end hasn't come when the watermark (of the events' own times) is that far
    past its start leaves with duration 0; an end that comes later closes the begin before it, or nothing.
    """
    if abandon_us is None:
        return events.groupBy(*THREAD).transformWithStateInPandas(OpenBegins(), EVENT_SCHEMA, "append", "none")
    timed = events.withColumn("at", F.timestamp_micros("ts")).withWatermark("at", "0 seconds")
    return timed.groupBy(*THREAD).transformWithStateInPandas(OpenBegins(abandon_us), EVENT_SCHEMA, "append", "eventTime")


def stream_totals(events: DataFrame, by: str = "name") -> DataFrame:
    """Running totals by trace and key, for complete or update mode: count, total_dur, min_ts, max_ts."""
    key = F.col("name" if by == "name" else "cat").alias("key")
    return events.groupBy("trace_id", key).agg(F.count("*").alias("count"), F.sum("dur").alias("total_dur"), F.min("ts").alias("min_ts"), F.max(F.col("ts") + F.col("dur")).alias("max_ts"))
