"""A stream over text files that grow below ``dt=*/hr=*`` folders: every complete line once, by byte offset.

The offset of the stream says for each file of an open hour how many bytes were taken, so Spark's checkpoint is the ledger
and a load reads only what was appended since. Hours up to the last one of an unbroken run with close markers
(``_SUCCESS``) are named by that hour alone: their files are complete, and the offset does not grow with the data. Of an
open hour bytes up to the last line end count; a half-written line waits for the load that finds it finished. A file that
shrinks gives nothing until it has grown past what was taken.

Folders are listed and files are opened with Arrow's file systems (local or mounted folders, S3, GCS, HDFS), in tasks by
ranges of ``RANGE`` bytes: a line belongs to the range in which it begins. Gzipped files (``.gz``) are whole when they
appear, or grow by whole gzip members: what is new in one is one range, unpacked as a stream. A task reads one range, or
several small ones, so the tasks follow the bytes and not the files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE = 64 << 20
BLOCK = 1 << 20
MARKER = "_SUCCESS"
PACKED = ".gz"
OPENING = 64 << 10  # bytes that could be read while a file is opened
UNPACKED = 8  # bytes of text that a gzipped byte is taken for
THREADS = 16  # that list folders and look at file ends
TASKS = 32


@dataclass
class ByteRange(InputPartition):
    """The lines that begin in ``[begin, end)`` of a file; what is read never passes ``stop``."""

    file: str
    begin: int
    end: int
    stop: int
    first: bool  # whether a line begins at ``begin``
    more: list[ByteRange] = field(default_factory=list)  # ranges that the same task reads after this one

    @property
    def cost(self) -> int:
        return OPENING + (self.end - self.begin) * (UNPACKED if self.file.endswith(PACKED) else 1)


def dealt(ranges: list[ByteRange], tasks: int) -> list[ByteRange]:
    """The ranges by task, in their order: small ones go together up to ``RANGE`` bytes, as long as that leaves ``tasks``."""
    most = min(RANGE, max(BLOCK, sum(r.cost for r in ranges) // tasks))
    out, held = [], 0
    for r in ranges:
        if out and held + r.cost <= most:
            out[-1].more.append(r)
            held += r.cost
        else:
            out.append(r)
            held = r.cost
    return out


def last_line_end(files: fs.FileSystem, path: str, size: int) -> int:
    """How many of the first ``size`` bytes are complete lines."""
    with files.open_input_file(path) as f:
        at = size
        while at > 0:
            begin = max(0, at - BLOCK)
            found = f.read_at(at - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


def lines_of(files: fs.FileSystem, part: ByteRange) -> Iterator[bytes]:
    """The lines of a range, some at a time; an unfinished last one only where the file is complete."""
    with files.open_input_file(part.file) as f:
        at, rest = part.begin, b""
        if not part.first:
            # the line that runs into this range belongs to the one before, unless it ended just before it
            at = part.begin - 1
            while at < part.stop:
                block = f.read_at(min(BLOCK, part.stop - at), at)
                found = block.find(b"\n")
                if found >= 0:
                    at += found + 1
                    break
                at += len(block)
        begin = at  # of the line that ``rest`` holds the start of
        while at < part.stop and begin < part.end:
            block = f.read_at(min(BLOCK, part.stop - at), at)
            if not block:
                break
            at += len(block)
            lines, rest = cut(rest, block)
            if begin + len(lines) > part.end:  # the last line to take holds the last byte of the range
                lines = lines[:lines.find(b"\n", part.end - 1 - begin) + 1]
                begin = part.end
            begin += len(lines)
            if lines:
                yield lines
        if rest and begin < part.end and at >= part.stop:
            yield rest


def cut(rest: bytes, block: bytes) -> tuple[bytes, bytes]:
    """What was left over and the block after it, cut behind the last line end."""
    end = block.rfind(b"\n") + 1
    return (rest + block[:end], block[end:]) if end else (b"", rest + block)


def values(lines: bytes) -> pa.Array:
    """Each line without its end, as text."""
    found = pc.split_pattern(pa.array([lines.removesuffix(b"\n")], pa.binary()), b"\n").flatten()
    try:
        return found.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are not UTF-8
        return pa.array([line.decode("utf-8", "replace") for line in found.to_pylist()], pa.string())


def unpacked(f: pa.NativeFile, part: ByteRange) -> Iterator[bytes]:
    """The content of the gzip members in a range, at most ``BLOCK`` bytes at a time."""
    at, member, begun = part.begin, zlib.decompressobj(31), False
    while at < part.stop:
        block = f.read_at(min(BLOCK, part.stop - at), at)
        if not block:
            break
        at += len(block)
        while block:
            yield member.decompress(block, BLOCK)
            block, begun = member.unconsumed_tail, True
            if member.eof:
                block, member, begun = member.unused_data, zlib.decompressobj(31), False
    if begun:
        yield member.flush()
        if not member.eof:
            raise ValueError(f"{part.file} ends inside a gzip member")


def packed_lines_of(files: fs.FileSystem, part: ByteRange) -> Iterator[bytes]:
    """The lines of a range of gzip members, some at a time."""
    with files.open_input_file(part.file) as f:
        rest = b""
        for block in unpacked(f, part):
            lines, rest = cut(rest, block)
            if lines:
                yield lines
        if rest:
            yield rest


class GrownLinesReader(DataSourceStreamReader):
    def __init__(self, path: str, tasks: int = TASKS):
        self.files, self.root = fs.FileSystem.from_uri(path)
        self.tasks = tasks

    def _folders(self, path: str) -> list[fs.FileInfo]:
        return self.files.get_file_info(fs.FileSelector(path, allow_not_found=True))

    def hours(self) -> dict[str, list[fs.FileInfo]]:
        """What each ``dt=/hr=`` folder holds, oldest first."""
        days = sorted(d.path for d in self._folders(self.root) if d.base_name.startswith("dt="))
        with ThreadPoolExecutor(THREADS) as pool:
            found = sorted(h.path for day in pool.map(self._folders, days) for h in day if h.base_name.startswith("hr="))
            return {h[len(self.root.rstrip("/")) + 1:]: held for h, held in zip(found, pool.map(self._folders, found), strict=True)}

    @staticmethod
    def _data(hour: list[fs.FileInfo]) -> list[fs.FileInfo]:
        return sorted((f for f in hour if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path)

    def initialOffset(self) -> dict:
        return {"through": "", "files": {}}

    def latestOffset(self) -> dict:
        through, found, unbroken = "", {}, True
        for hour, held in self.hours().items():
            unbroken = unbroken and any(f.base_name == MARKER for f in held)
            if unbroken:
                through = hour
            else:
                found |= {f"{hour}/{f.base_name}": f for f in self._data(held)}
        with ThreadPoolExecutor(THREADS) as pool:
            return {"through": through, "files": dict(zip(found, pool.map(self._taken, found.values()), strict=True))}

    def _taken(self, f: fs.FileInfo) -> int:
        return f.size if f.base_name.endswith(PACKED) else last_line_end(self.files, f.path, f.size)

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        upto = dict(end["files"])
        if end["through"] > start["through"]:
            for hour, found in self.hours().items():
                if start["through"] < hour <= end["through"]:
                    upto |= {f"{hour}/{f.base_name}": f.size for f in self._data(found)}
        out = []
        for name, stop in sorted(upto.items()):
            begin = start["files"].get(name, 0)
            step = max(1, stop - begin) if name.endswith(PACKED) else RANGE
            for at in range(begin, stop, step):
                out.append(ByteRange(f"{self.root.rstrip('/')}/{name}", at, min(at + step, stop), stop, at == begin))
        return dealt(out, self.tasks)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        for part in (partition, *partition.more):
            found = packed_lines_of if part.file.endswith(PACKED) else lines_of
            for lines in found(self.files, part):
                yield pa.RecordBatch.from_arrays([values(lines)], ["value"])


class GrownLines(DataSource):
    """``spark.readStream.format("grown_lines").load(path)`` has one column, ``value``."""

    @classmethod
    def name(cls) -> str:
        return "grown_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> GrownLinesReader:
        return GrownLinesReader(self.options["path"], int(self.options.get("tasks", TASKS)))


def grown_lines(spark: SparkSession, path: str):
    """The stream of complete lines below ``path``; a load is dealt to some tasks per core where it has the bytes."""
    spark.dataSource.register(GrownLines)
    return spark.readStream.format("grown_lines").option("tasks", 4 * spark.sparkContext.defaultParallelism).load(path)
