"""A streaming source of text lines in the order in which their files landed."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, seq long, value binary"
#: A line's number: its file's in order of landing, then where it begins in the file (1 TB at most).
FILE_BITS, PLACE_BITS = 23, 40
RANGE_BYTES = 64 << 20
BATCH_BYTES = 1 << 20


@dataclass
class Range(InputPartition):
    """Lines of one file that begin from ``start`` to before ``end``."""

    number: int
    path: str
    start: int
    end: int


class LandingLog:
    """The files of a folder in order of landing: those first seen together by time and path. Kept in files of its own, so that
    numbers outlive the stream that gave them."""

    def __init__(self, folder: str, log: str):
        self.files, self.base = fs.FileSystem.from_uri(folder)
        self.log_files, self.log = fs.FileSystem.from_uri(log)
        self.prefix = folder[: len(folder) - len(self.base)] if folder.endswith(self.base) else ""
        self.seen: list[tuple[str, int]] = []
        self._read()

    def _read(self) -> None:
        while True:
            name = f"{self.log}/{len(self.seen):012d}.json"
            if self.log_files.get_file_info(name).type != fs.FileType.File:
                return
            with self.log_files.open_input_stream(name) as file:
                self.seen += [tuple(x) for x in json.loads(file.read())]

    def update(self) -> int:
        """Looks for files that have landed since; how many there are now."""
        self._read()
        known = {path for path, _ in self.seen}
        found = self.files.get_file_info(fs.FileSelector(self.base, recursive=True, allow_not_found=True))
        plain = [i for i in found if i.is_file and not any(part[:1] in "_." for part in i.path[len(self.base) :].strip("/").split("/"))]
        new = sorted((i.mtime_ns or 0, i.path, i.size) for i in plain if i.path not in known)
        if new:
            if len(self.seen) + len(new) > 1 << FILE_BITS:
                raise ValueError(f"more than {1 << FILE_BITS} files have landed: start another folder")
            self.log_files.create_dir(self.log, recursive=True)
            name = f"{self.log}/{len(self.seen):012d}.json"
            with self.log_files.open_output_stream(f"{name}.new") as file:
                file.write(json.dumps([(path, size) for _, path, size in new]).encode())
            self.log_files.move(f"{name}.new", name)
            self._read()
        return len(self.seen)


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, log: str, range_bytes: int):
        self.folder, self.log, self.range_bytes = folder, log, range_bytes

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": LandingLog(self.folder, self.log).update()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for number, (path, size) in enumerate(LandingLog(self.folder, self.log).seen[start["files"] : end["files"]], start["files"]):
            if size >= 1 << PLACE_BITS:
                raise ValueError(f"{path} is too long to number its lines")
            step = max(1, size) if path.endswith(".gz") else self.range_bytes
            out += [Range(number, path, at, at + step) for at in range(0, size, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(self.folder)
        prefix = self.folder[: len(self.folder) - len(base)] if self.folder.endswith(base) else ""
        with files.open_input_file(partition.path) as file:
            lines = _zipped_lines(file) if partition.path.endswith(".gz") else lines_between(file, partition.start, partition.end)
            held, size = [], 0
            for at, line in lines:
                held.append((at, line))
                size += len(line) + 32
                if size >= BATCH_BYTES:
                    yield _batch(prefix + partition.path, partition.number, held)
                    held, size = [], 0
            if held:
                yield _batch(prefix + partition.path, partition.number, held)


def _batch(path: str, number: int, lines: list[tuple[int, bytes]]) -> pa.RecordBatch:
    seqs = pa.array([(number << PLACE_BITS) + at for at, _ in lines], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), seqs, pa.array([line for _, line in lines], pa.binary())], ["path", "seq", "value"])


def _split(chunks: Iterator[bytes], at: int) -> Iterator[tuple[int, bytes]]:
    """Lines and where they begin."""
    rest: list[bytes] = []
    for chunk in chunks:
        *lines, last = chunk.split(b"\n")
        for line in lines:
            line = b"".join([*rest, line])
            rest = []
            yield at, line
            at += len(line) + 1
        rest.append(last)
    if any(rest):
        yield at, b"".join(rest)


def lines_between(file, start: int, end: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Lines of ``file`` that begin from ``start`` to before ``end``."""
    first = max(0, start - 1)  # a line that ends there doesn't begin here
    file.seek(first)
    for at, line in _split(iter(lambda: file.read(chunk), b""), first):
        if at >= end:
            return
        if at > first or not start:
            yield at, line


def _zipped_lines(file, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    def inflated() -> Iterator[bytes]:
        inflate = zlib.decompressobj(31)
        for raw in iter(lambda: file.read(chunk), b""):
            while raw:
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
                yield inflate.decompress(raw)
                raw = inflate.unused_data
        if not inflate.eof:
            raise ValueError("the gzip file is cut off")

    return _split(inflated(), 0)


class LandedLines(DataSource):
    """Options: path (a folder), log (where the order of landing is kept; ``_landing`` in the folder unless given), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "landed_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        folder = self.options["path"].rstrip("/")
        return _Reader(folder, self.options.get("log", f"{folder}/_landing"), int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))
