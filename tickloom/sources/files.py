"""Input files: listing, ranged reads and an ordered line source.

Spark's text reader gives no line order. The ``ordered_lines`` data source splits every file
into byte ranges (one task each, small files together) and emits each line with its byte offset, so the order of a
file survives and a large file is read in parallel.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 * 1024 * 1024
# Small files share a task up to this many bytes.
PACK_BYTES = 8 * 1024 * 1024


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a local path or URI."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(paths: Sequence[str]) -> list[tuple[str, int]]:
    """(path, size) of all files, directories expanded in name order, hidden ones skipped."""
    found = []
    for path in paths:
        system, plain = open_path(path)
        info = system.get_file_info(plain)
        if info.type == fs.FileType.File:
            found.append((path, info.size))
        elif info.type == fs.FileType.Directory:
            inside = system.get_file_info(fs.FileSelector(plain, recursive=True))
            # Entries come without the scheme of the folder they were found in.
            scheme = path.rstrip("/").removesuffix(plain.rstrip("/")) if path != plain else ""
            for item in sorted(inside, key=lambda x: x.path):
                hidden = any(p[:1] in "._" for p in item.path[len(plain):].split("/") if p)
                if item.type == fs.FileType.File and not hidden:
                    found.append((scheme + item.path, item.size))
        else:
            raise FileNotFoundError(path)
    return found


def read_head(path: str, size: int) -> bytes:
    system, plain = open_path(path)
    with system.open_input_stream(plain) as stream:
        return stream.read(size)


def numbered_files(paths: Sequence[str], numbers: str) -> list[tuple[int, str, int]]:
    """(number, path, size) of the listed files: numbered as told, one each, or from 0."""
    files = list_files(paths)
    given = [int(n) for n in numbers.split(",")] if numbers else range(len(files))
    return [(n, path, size) for n, (path, size) in zip(given, files, strict=True)]


@dataclass
class FileRange(InputPartition):
    path: str
    file_no: int
    begin: int
    end: int
    size: int


@dataclass
class FileRanges(InputPartition):
    ranges: list[FileRange]


def packed(ranges: Sequence[FileRange], limit: int) -> list[FileRanges]:
    """Neighbouring ranges gathered up to ``limit`` bytes a task; a longer one stays alone."""
    tasks, room = [], 0
    for part in ranges:
        size = part.end - part.begin
        if not tasks or size > room:
            tasks.append(FileRanges([]))
            room = limit
        tasks[-1].ranges.append(part)
        room -= size
    return tasks


class OrderedLines(DataSource):
    """``spark.read.format("ordered_lines")``; options: paths (newline separated), split."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return "file STRING, file_no INT, offset BIGINT, raw BINARY, ended BOOLEAN"

    def reader(self, schema) -> "OrderedLinesReader":
        return OrderedLinesReader(self.options)


class OrderedLinesReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["paths"].split("\n")
        self.numbers = options.get("numbers", "")
        self.split = int(options.get("split", SPLIT_BYTES))

    def partitions(self) -> list[FileRanges]:
        ranges = []
        for number, path, size in numbered_files(self.paths, self.numbers):
            for begin in range(0, size, self.split):
                ranges.append(FileRange(path, number, begin, min(begin + self.split, size), size))
        return packed(ranges, min(self.split, PACK_BYTES)) or [FileRanges([])]

    def read(self, task: FileRanges) -> Iterator[pa.RecordBatch]:
        for part in task.ranges:
            yield from self._lines(part)

    def _lines(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        system, plain = open_path(part.path)
        with system.open_input_file(plain) as file:
            begin = part.begin
            if begin > 0:
                # A line belongs to the range its first byte lies in.
                begin = _after_newline(file, begin - 1, part.end, part.size)
            carry, position = b"", begin
            while position + len(carry) < part.end or carry:
                at = position + len(carry)
                want = min(4 * 1024 * 1024, part.size - at)
                chunk = file.read_at(want, at) if want > 0 else b""
                data = carry + chunk
                if not data:
                    break
                last = at + len(chunk) >= part.size
                cut = len(data) if last else data.rfind(b"\n") + 1
                if cut == 0:
                    carry = data
                    continue
                lines, offsets, at_line = [], [], position
                pieces = data[:cut].split(b"\n")
                ended = pieces[-1] == b""
                if ended:
                    pieces.pop()
                for piece in pieces:
                    if at_line >= part.end:
                        break
                    lines.append(piece)
                    offsets.append(at_line)
                    at_line += len(piece) + 1
                else:
                    at_line = None
                flags = [True] * len(lines)
                if lines and at_line is None and not ended:
                    flags[-1] = False
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.path] * len(lines), pa.string()),
                        pa.array([part.file_no] * len(lines), pa.int32()),
                        pa.array(offsets, pa.int64()),
                        pa.array(lines, pa.binary()),
                        pa.array(flags, pa.bool_()),
                    ],
                    names=["file", "file_no", "offset", "raw", "ended"],
                )
                if at_line is not None or last:
                    break
                carry, position = data[cut:], position + cut
                if position >= part.end:
                    break


def _after_newline(file, position: int, end: int, size: int) -> int:
    """First position after the next newline at or after ``position``; ``size`` if none."""
    while position < size:
        chunk = file.read_at(min(65_536, size - position), position)
        found = chunk.find(b"\n")
        if found >= 0:
            return position + found + 1
        position += len(chunk)
    return size


def ordered_lines(
    spark: SparkSession, paths: Sequence[str], split: int = SPLIT_BYTES,
    numbers: Sequence[int] | None = None,
) -> DataFrame:
    """All lines of the files with file number and byte offset."""
    spark.dataSource.register(OrderedLines)
    return (
        spark.read.format("ordered_lines")
        .option("paths", "\n".join(paths))
        .option("split", str(split))
        .option("numbers", ",".join(map(str, numbers or [])))
        .load()
    )
