"""JSON documents of events read in byte ranges, by many tasks each.

A document is read as text cut at every closing brace, so any number of tasks share it. What a range closes and leaves
open is told without knowing what comes before it; composed in order, this tells where each range begins, and then each
reads its own events. Events that lie in several ranges are put together from their fragments.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.sources.shared import shared_path

#: Strings, brackets and braces; a string may go on behind the piece.
_MARKS = re.compile(rb'"(?:[^"\\]|\\.)*+(?:(")|\\?$)|[\[\]{]', re.DOTALL)
_STRING_END = re.compile(rb'(?:[^"\\]|\\.)*+"', re.DOTALL)
_KEY = b'"traceEvents"'
#: Open brackets: an object, an array, the array of events, and a root object in which that array was seen.
OBJECT, ARRAY, EVENTS, ROOT = "{", "[", "t", "R"
#: What stands for the brackets of a file that is compressed.
ZIPPED, MAGIC = "Z", b"\x1f\x8b"

SUMMARY = "_path string, _start long, file_size long, inside boolean, size long, out_inside boolean, closes int, opens string, marks array<int>"
STATE = "_path string, _start long, inside boolean, opens string, since array<long>, ends_closed boolean"
FOUND = "_path string, _start long, at long, part long, value binary, last boolean, cancelled boolean"


#: What is looked at together: about so many bytes.
CHUNK = 1 << 20
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")] = 1
_STEP[list(b"}]")] = -1


def structure(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where brackets and braces outside strings stand, whether each opens (1) or closes (-1), and whether a string is open at
    the end, given whether one is at the start."""
    raw = np.frombuffer(text, np.uint8)
    quotes = raw == ord('"')
    if b"\\" in text:
        slashes = np.flatnonzero(raw == ord("\\"))
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        size = np.diff(np.append(first, len(slashes)))
        behind = slashes[first + size - 1][size % 2 == 1] + 1  # an odd run escapes what follows
        quotes[behind[behind < len(raw)]] = False
    at = np.flatnonzero(quotes)
    marks = np.flatnonzero(_STEP[raw])
    marks = marks[(np.searchsorted(at, marks) + inside) % 2 == 0]
    return marks, _STEP[raw[marks]].astype(np.int64), bool((len(at) + inside) % 2)


class Brackets:
    """The brackets open at a place of a document whose pieces come in order, each ended by a closing brace."""

    def __init__(self, opens: str = "", inside: bool = False, since: list[int] | None = None, here: int = 0):
        self.stack, self.inside, self.here = list(opens), inside, here
        self.since = list(since or [here] * len(self.stack))
        self.closes, self.marks = 0, []
        self.key = False

    def feed(self, piece: bytes, closed: bool = True) -> None:
        at = 0
        if self.inside:
            end = _STRING_END.match(piece)
            if not end:
                # A backslash at the end of the piece escapes the brace.
                return
            self.inside, at, self.key = False, end.end(), False
        for mark in _MARKS.finditer(piece, at):
            text = mark.group()
            if text == b"{":
                self._open(OBJECT, mark.start())
            elif text == b"[":
                self._open(EVENTS if self.key else ARRAY, mark.start())
            elif text == b"]":
                self._close()
            elif not mark.group(1):
                self.inside = True
                return
            self.key = text == _KEY
        if closed and not self.inside:
            self._close()
            self.key = False

    def feed_chunk(self, pieces: list[bytes]) -> None:
        """As ``feed`` for each of ``pieces``, all at once where the key doesn't occur."""
        text = b"}".join([*pieces, b""])
        if _KEY in text:
            for piece in pieces:
                self.feed(piece)
            return
        marks, steps, inside = structure(text, self.inside)
        self._move(text, marks, steps)
        self.inside, self.key = inside, False

    def _move(self, text: bytes, marks: np.ndarray, steps: np.ndarray) -> None:
        """The stack behind ``marks``: what isn't closed on the way stays, and the last rise to each level above is open."""
        if not len(marks):
            return
        depth = len(self.stack) + np.cumsum(steps)
        low, high = min(len(self.stack), int(depth.min())), int(depth[-1])
        last = (int(np.flatnonzero((depth == level) & (steps == 1))[-1]) for level in range(low + 1, high + 1))
        opened = [chr(text[int(marks[i])]) for i in last]
        self.closes += max(0, -low)
        self.stack[max(0, low) :] = opened
        self.since[max(0, low) :] = [self.here] * len(opened)

    def _open(self, kind: str, at: int) -> None:
        if kind == EVENTS:
            if not self.stack:
                self.marks.append(self.closes)
            elif self.stack[-1] == OBJECT and len(self.stack) == 1:
                self.stack[-1] = ROOT
        self.stack.append(kind)
        self.since.append(self.here)

    def _close(self) -> None:
        if self.stack:
            self.stack.pop()
            self.since.pop()
        else:
            self.closes += 1


def event_level(stack: list[str]) -> int | None:
    """The place in ``stack`` where the event is that is open, if one is."""
    if not stack:
        return None
    if stack[0] in (ARRAY, EVENTS):
        at = 1
    elif stack[0] == ROOT and len(stack) > 1 and stack[1] == EVENTS:
        at = 2
    else:
        return 0 if stack[0] == OBJECT else None
    return at if len(stack) > at and stack[at] == OBJECT else None


class Events(Brackets):
    """Brackets from a known beginning, which hand out the objects in the array of events, or one root object after another."""

    def __init__(self, *place):
        super().__init__(*place)
        self.level = event_level(self.stack)
        self.began = self.since[self.level] if self.level is not None else self.here
        self.held: list[bytes] = []
        self.first, self.cancelled = 0, None

    def _open(self, kind: str, at: int) -> None:
        before = event_level(self.stack)
        super()._open(kind, at)
        now = event_level(self.stack)
        if before is not None and now != before:  # the root object isn't an event
            if self.began != self.here:
                self.cancelled = self.began
            self.held, self.level = [], None
        if now is not None and before is None:
            self.level, self.began, self.held = now, self.here, []
            self.first = at

    def take(self, piece: bytes, closed: bool) -> tuple[int, bytes] | None:
        """The event that ends with this piece, if one does: the range in which it began, and its text here."""
        self.first = 0
        self.feed(piece, closed)
        if self.level is None:
            return None
        self.held.append(piece[self.first :] + (b"}" if closed else b""))
        if event_level(self.stack) == self.level:
            return None
        text, self.held, self.level = b"".join(self.held), [], None
        return self.began, text


    def take_chunk(self, pieces: list[bytes], closed: bool) -> list[tuple[int, bytes]]:
        """As ``take`` for each of ``pieces``, all at once where the array that holds the events, or none, stays open."""
        text = b"}".join([*pieces, b""]) if closed else b"}".join(pieces)
        found = None if _KEY in text else self._objects(text)
        if found is None:
            last = len(pieces) - 1
            found = [x for i, piece in enumerate(pieces) if (x := self.take(piece, closed or i < last))]
        return found

    def _objects(self, text: bytes) -> list[tuple[int, bytes]] | None:
        if not self.stack or self.stack[0] == OBJECT:
            level = 0
        elif self.stack[0] == ROOT:
            level = 2 if self.stack[1:2] == [EVENTS] else None
        else:
            level = 1
        if level is None:
            return None
        marks, steps, inside = structure(text, self.inside)
        depth = len(self.stack) + np.cumsum(steps)
        braces = np.isin(np.frombuffer(text, np.uint8)[marks], list(b"{}"))
        rises = (steps == 1) & (depth == level + 1)
        if (len(depth) and depth.min() < level) or (level == 0 and (rises & ~braces).any()):
            return None
        starts, ends = marks[rises & braces], marks[(steps == -1) & (depth == level) & braces]
        out, opened = [], self.level is not None
        ending = np.argsort(np.concatenate([starts, ends]), kind="stable") >= len(starts)
        if (ending != ((np.arange(len(ending)) + opened) % 2 == 1)).any():
            return None  # they don't alternate: a bracket closes a brace
        if opened and not len(ends):
            self.held.append(text)
        elif opened:
            out.append((self.began, b"".join([*self.held, text[: int(ends[0]) + 1]])))
            self.held, self.level, ends = [], None, ends[1:]
        out += [(self.here, text[low : high + 1]) for low, high in zip(starts.tolist(), ends.tolist(), strict=False)]
        if len(starts) > len(ends):
            self.level, self.began, self.held = level, self.here, [text[int(starts[-1]) :]]
        self._move(text, marks, steps)
        self.inside, self.key = inside, False
        return out


def _chunks(pieces: Iterator[bytes]) -> Iterator[tuple[list[bytes], bool]]:
    """Pieces in lists of growing size, and whether each is the last."""
    held, size, most, piece = [], 0, CHUNK >> 6, next(pieces, None)
    while piece is not None:
        held.append(piece)
        size, piece = size + len(piece) + 1, next(pieces, None)
        if size >= most or piece is None:
            yield held, piece is None
            held, size, most = [], 0, min(CHUNK, 2 * most)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """The ranges of a task, each with its pieces. Rows of a range are rows in a row."""
    runs = _runs(batches)
    run = next(runs, None)
    while run is not None:
        here = run[0]

        def pieces() -> Iterator[bytes]:
            nonlocal run
            while run is not None and (run[0]["_path"], run[0]["_start"]) == (here["_path"], here["_start"]):
                yield from run[1]
                run = next(runs, None)

        own = pieces()
        yield here, own
        for _ in own:  # whatever was left unread
            pass


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    for batch in batches:
        changed = np.zeros(max(0, batch.num_rows - 1), bool)
        for name in ("_path", "_start"):
            changed |= pc.not_equal(batch[name][1:], batch[name][:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if low < high:
                yield {c: batch[c][low].as_py() for c in batch.schema.names if c != "value"}, batch["value"][low:high].to_pylist()


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for place, pieces in _ranges(batches):
        ways, size, zipped = [Brackets(), Brackets(inside=True)], 0, False
        for chunk, _ in _chunks(pieces):
            zipped = zipped or (not size and not place["_start"] and chunk[0][:2] == MAGIC)
            size += sum(map(len, chunk)) + len(chunk)
            for way in () if zipped else ways:
                way.feed_chunk(chunk)
        if zipped:
            ways = [Brackets(ZIPPED), Brackets(ZIPPED, True)]
        rows += [place | {"inside": i == 1, "size": size, "out_inside": w.inside, "closes": w.closes, "opens": "".join(w.stack), "marks": w.marks} for i, w in enumerate(ways)]
    yield pa.RecordBatch.from_pylist(rows, pa.schema([("_path", pa.string()), ("_start", pa.int64()), ("file_size", pa.int64()), ("inside", pa.bool_()), ("size", pa.int64()), ("out_inside", pa.bool_()), ("closes", pa.int32()), ("opens", pa.string()), ("marks", pa.list_(pa.int32()))]))


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each range of a document begins, in order of the ranges; those of a document are rows in a row."""
    path, inside, stack, since, size, held = None, False, [], [], 0, None
    schema = pa.schema([("_path", pa.string()), ("_start", pa.int64()), ("inside", pa.bool_()), ("opens", pa.string()), ("since", pa.list_(pa.int64())), ("ends_closed", pa.bool_())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["_path"] != path:
                path, inside, stack, since, size = row["_path"], False, [], [], 0
            if row["inside"] != inside or (row["_path"], row["_start"]) == held:
                continue
            held = (row["_path"], row["_start"])
            size += row["size"]
            out.append({"_path": path, "_start": row["_start"], "inside": inside, "opens": "".join(stack), "since": list(since), "ends_closed": size != row["file_size"] + 1})
            if stack == [ZIPPED]:
                continue
            for mark in row["marks"]:
                if len(stack) - 1 == mark and stack[0] == OBJECT:
                    stack[0] = ROOT
            kept = max(0, len(stack) - row["closes"])
            opens = row["opens"].replace(ROOT, OBJECT) if kept else row["opens"]
            stack, since, inside = stack[:kept] + list(opens), since[:kept] + [row["_start"]] * len(opens), row["out_inside"]
        yield pa.RecordBatch.from_pylist(out, schema)


_FOUND = pa.schema([("_path", pa.string()), ("_start", pa.int64()), ("at", pa.int64()), ("part", pa.int64()), ("value", pa.binary()), ("last", pa.bool_()), ("cancelled", pa.bool_())])


def _events_of(place: dict, pieces: Iterator[bytes], fragments: bool) -> Iterator[dict]:
    """Events of a range, or the fragments of those that also lie in others, a row each."""
    for row, texts in _texts_of(place, pieces, fragments):
        yield from (row | {"at": row["at"] + i, "value": text} for i, text in enumerate(texts))


def _texts_of(place: dict, pieces: Iterator[bytes], fragments: bool) -> Iterator[tuple[dict, list[bytes]]]:
    """Events of a range, or the fragments of those that also lie in others: several texts with what the first one's row has
    besides; the others count on from its place."""
    here, part = place["_start"], place["_start"]
    scan = Events(place["opens"] or "", bool(place["inside"]), place["since"], here)
    row = {"_path": place["_path"], "part": part, "last": True, "cancelled": False}
    whole, at, size = place["opens"] is None, 0, 0
    piece = next(pieces, None)
    zipped = not here and piece is not None and piece[:2] == MAGIC
    if place["opens"] == ZIPPED or (zipped and not whole):
        return  # read as a whole elsewhere
    if zipped:
        whole, place, pieces = False, place | {"ends_closed": False}, pieces_of(_bytes(chain([piece], pieces), place["file_size"]))
        piece = next(pieces, None)
    for chunk, last in _chunks(chain([piece], pieces) if piece is not None else pieces):
        size += sum(map(len, chunk)) + len(chunk)
        open_end = size == (place["file_size"] or 0) + 1 if whole else not place["ends_closed"]
        found = scan.take_chunk(chunk, not (last and open_end))
        own = [text for began, text in found if began == here]
        if not fragments and own:
            yield row | {"_start": here, "at": at}, own
        elif fragments:
            yield from ((row | {"_start": began, "at": -1}, [text]) for began, text in found if began != here)
        at += len(own)
        if scan.cancelled is not None and fragments:
            yield row | {"_start": scan.cancelled, "at": -1, "cancelled": True}, [b""]
        scan.cancelled = None
    if fragments and scan.level is not None and scan.held:
        yield row | {"_start": scan.began, "at": at if scan.began == here else -1, "last": False}, [b"".join(scan.held)]


def _batched(found: Iterator[tuple[dict, list[bytes]]], most: int = 4096, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held, count, held_bytes = [], 0, 0
    for row, texts in found:
        for i in range(0, len(texts), most):
            held.append((row | {"at": row["at"] + i}, texts[i : i + most]))
            count += len(held[-1][1])
            held_bytes += sum(map(len, held[-1][1]))
            if count >= most or held_bytes >= size:
                yield _rows(held)
                held, count, held_bytes = [], 0, 0
    if held:
        yield _rows(held)


def _rows(held: list[tuple[dict, list[bytes]]]) -> pa.RecordBatch:
    """A row for each text."""
    counts = np.array([len(texts) for _, texts in held])
    which = np.repeat(np.arange(len(held)), counts)
    columns = {c.name: pa.array([row[c.name] for row, _ in held], c.type).take(pa.array(which)) for c in _FOUND if c.name != "value"}
    columns["at"] = pa.array(columns["at"].to_numpy() + np.arange(len(which)) - (np.cumsum(counts) - counts)[which])
    columns["value"] = pa.array(chain.from_iterable(texts for _, texts in held), pa.binary())
    return pa.RecordBatch.from_arrays([columns[c] for c in _FOUND.names], schema=_FOUND)


def _reader(fragments: bool):
    return lambda batches: _batched(found for place, pieces in _ranges(batches) for found in _texts_of(place | {"since": [int(x) for x in (place["since"] or "").split()]}, pieces, fragments))


def _bytes(pieces: Iterator[bytes], file_size: int | None) -> Iterator[bytes]:
    """What a file holds, from its pieces. Whether the last one was ended by a brace, the file's size says."""
    size, piece = 0, next(pieces, None)
    while piece is not None:
        size, following = size + len(piece) + 1, next(pieces, None)
        yield piece + b"}" if following is not None or size == file_size else piece
        piece = following


def pieces_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The pieces of a gzip file between closing braces; ValueError if it is corrupt or cut off."""
    inflate, rest = zlib.decompressobj(31), b""
    for chunk in chunks:
        while chunk:
            if inflate.eof:  # another member of the same file
                inflate = zlib.decompressobj(31)
            try:
                *pieces, rest = (rest + inflate.decompress(chunk)).split(b"}")
            except zlib.error as broken:
                raise ValueError(f"the gzip file is corrupt: {broken}") from broken
            yield from pieces
            chunk = inflate.unused_data
    if not inflate.eof:
        raise ValueError("the gzip file is cut off")
    yield rest


def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple[dict, list[bytes]]]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place = {"_path": path, "_start": 0, "opens": "", "inside": False, "since": [], "ends_closed": False, "file_size": None}
                raw = content.as_py()
                yield from _texts_of(place, pieces_of(raw[i : i + (1 << 20)] for i in range(0, len(raw), 1 << 20)), False)

    return _batched(found())


def document_events(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, list[str]]:
    """The JSON text of each event in documents at ``paths`` (value), with its file (_path), the range of the file in which it
    begins (_start) and its place among the events that begin there (at). And all files.

    Files of one range are read once. Of others the brackets are read first, in parallel, and a row a range is stored in
    the shared folder; then events, and apart from them the fragments of those that lie in several ranges. Files that
    begin as gzip does are inflated by the task that reads them; one of several ranges is then read again as a whole.
    """
    listed = spark.read.text(paths).inputFiles()
    least = whole_file_bytes(spark)
    sized = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), "length")
    large = [r["path"] for r in sized.where((F.col("length") > least) & ~F.col("path").endswith(".gz")).collect()]
    if not large:
        return _whole(_pieces(spark, paths), None), listed
    states = _states(spark, large)
    out = _whole(_pieces(spark, paths), states).unionByName(_joined(_pieces(spark, large), states))
    zipped = [r["_path"] for r in states.where(F.col("opens") == ZIPPED).select("_path").distinct().collect()]
    if zipped:
        content = spark.read.format("binaryFile").load(zipped).select(F.col("_metadata.file_path").alias("path"), "content")
        out = out.unionByName(content.mapInArrow(_inflated, FOUND).select(*out.columns))
    return out, listed


def whole_file_bytes(spark: SparkSession) -> int:
    """A file of no more bytes is never cut into ranges."""
    return min(byte_count(spark.conf.get(f"spark.sql.files.{c}")) for c in ("maxPartitionBytes", "openCostInBytes"))


def byte_count(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", text.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    meta = {"_path": "file_path", "_start": "file_block_start", "file_size": "file_size", "length": "file_block_length"}
    return spark.read.option("lineSep", "}").text(paths).select(F.col("value").cast("binary").alias("value"), *(F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()))


def _states(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Where the ranges of documents begin, as a stored table."""
    shared = _pieces(spark, paths).where("length < file_size").drop("length")
    ways = shared.mapInArrow(_summarised, SUMMARY).repartition("_path").sortWithinPartitions("_path", "_start", "inside")
    path = shared_path(spark, "ranges")
    ways.mapInArrow(_composed, STATE).write.parquet(path)
    return spark.read.schema(STATE).parquet(path)


def _with_states(pieces: DataFrame, states: DataFrame, how: str) -> DataFrame:
    """Pieces in order, each with where its range begins; some 200 bytes a range, so 20 MB at most are broadcast.

    ``since`` as text: Spark asks for a batch's size at each row, for which Arrow goes through all null lists so far.
    """
    states = states.withColumn("since", F.array_join("since", " "))
    if states.count() <= 100_000:
        return pieces.join(F.broadcast(states), ["_path", "_start"], how)
    placed = pieces.withColumn("_row", F.monotonically_increasing_id()).join(states, ["_path", "_start"], how)
    return placed.repartition("_path", "_start").sortWithinPartitions("_path", "_start", "_row").drop("_row")


def _whole(pieces: DataFrame, states: DataFrame | None) -> DataFrame:
    """Events that lie in one range."""
    if states is None:
        nothing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in STATE.split(", ")[2:]}
        placed = pieces.withColumns(nothing | {"since": F.lit(None).cast("string")})
    else:
        placed = _with_states(pieces, states, "left")
    # A compressed file's size says nothing of its text's.
    known = placed.withColumn("file_size", F.when(~F.col("_path").endswith(".gz"), F.col("file_size"))).drop("length")
    return known.mapInArrow(_reader(False), FOUND).select("_path", "_start", "at", "value")


def _joined(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """Events that lie in several ranges, from their fragments."""
    placed = _with_states(pieces.where("length < file_size").drop("length"), states, "inner")
    fragments = placed.mapInArrow(_reader(True), FOUND)
    parts = F.sort_array(F.collect_list(F.struct("part", F.col("value").cast("string").alias("text"))))
    events = fragments.groupBy("_path", "_start").agg(F.max("at").alias("at"), parts.alias("parts"), F.bool_or("last").alias("ended"), F.bool_or("cancelled").alias("cancelled"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return events.where("ended and not cancelled").select("_path", "_start", "at", text.cast("binary").alias("value"))
