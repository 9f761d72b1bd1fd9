"""Lines of growing files from their tails: a Python data source of byte ranges, for batches and for streams.

A batch reads the last bytes of each file and nothing before them.  A stream keeps the place it has come to in each
file, reads the tail of a file it meets first, and later only what was appended; a line counts once its line feed is
there.  A partition is a group of files; a file is opened where the partition is read, through the file systems that
Arrow knows, so paths may be local or URIs that it can open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Fixed value: bytes of a tail.
TAIL_BYTES = 512 * 1024
#: Bytes of a partition's ranges, about, and of a look back for the last line feed.
GROUP_BYTES, LOOK_BACK = 64 << 20, 1 << 16


@dataclass
class Ranges(InputPartition):
    """(path, start, end) of some files; ``cut`` where the start may lie within a line."""

    ranges: list[tuple[str, int, int, bool]]

    def __post_init__(self):
        super().__init__(None)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sizes(path: str, suffix: str) -> dict[str, int]:
    """The sizes of the files below a folder, or of one file; none where there is nothing."""
    from pyarrow import fs

    system, inside = _system(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.File:
        return {path: info.size}
    if info.type == fs.FileType.NotFound:
        return {}
    found = system.get_file_info(fs.FileSelector(inside, recursive=True))
    head = path[: len(path) - len(inside)] if "://" in path else ""
    return {head + f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)}


def grouped(ranges: list[tuple[str, int, int, bool]], limit: int = GROUP_BYTES) -> list[Ranges]:
    """Ranges in groups of about ``limit`` bytes."""
    groups, size = [[]], 0
    for r in sorted(ranges):
        if groups[-1] and size + r[2] - r[1] > limit:
            groups.append([])
            size = 0
        groups[-1].append(r)
        size += r[2] - r[1]
    return [Ranges(g) for g in groups if g]


def read_bytes(path: str, start: int, end: int) -> bytes:
    system, inside = _system(path)
    with system.open_input_file(inside) as f:
        f.seek(start)
        return f.read(end - start)


def lines_of(partition: Ranges) -> Iterator[tuple[str, int, str]]:
    """(file, offset, value) of the lines of the ranges; the first line of a cut range is left out, and files that are gone are."""
    for path, start, end, cut in partition.ranges:
        try:
            data = read_bytes(path, start, end)
        except OSError:
            continue
        at = start
        for i, line in enumerate(data.split(b"\n")):
            if line.strip() and not (cut and i == 0):
                yield path, at, line.decode("utf-8", "replace")
            at += len(line) + 1


class _Batch(DataSourceReader):
    def __init__(self, path: str, tail: int, suffix: str):
        self.path, self.tail, self.suffix = path, tail, suffix

    def partitions(self):
        return grouped([(p, max(0, n - self.tail), n, n > self.tail) for p, n in sizes(self.path, self.suffix).items()]) or [Ranges([])]

    def read(self, partition):
        yield from lines_of(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, tail: int, suffix: str):
        self.path, self.tail, self.suffix = path, tail, suffix

    def initialOffset(self):
        return {}

    def latestOffset(self):
        """The place after the last line feed of each file."""
        out = {}
        for path, size in sizes(self.path, self.suffix).items():
            end = size
            while end > 0:
                start = max(0, end - LOOK_BACK)
                last = read_bytes(path, start, end).rfind(b"\n")
                if last >= 0:
                    out[path] = start + last + 1
                    break
                end = start
        return out

    def partitions(self, start, end):
        ranges = []
        for path, to in end.items():
            since = start.get(path)
            if since is None or since > to:  # new, or written anew
                ranges.append((path, max(0, to - self.tail), to, to > self.tail))
            elif since < to:
                ranges.append((path, since, to, False))
        return grouped(ranges)

    def read(self, partition):
        yield from lines_of(partition)


class Tail(DataSource):
    """``format("tail")``: path, tailBytes, suffix -> file, offset, value."""

    @classmethod
    def name(cls):
        return "tail"

    def schema(self):
        return "file string, offset long, value string"

    def _given(self):
        return self.options["path"], int(self.options.get("tailBytes", TAIL_BYTES)), self.options.get("suffix", ".jsonl")

    def reader(self, schema):
        return _Batch(*self._given())

    def streamReader(self, schema):
        return _Stream(*self._given())


def records(lines: DataFrame) -> DataFrame:
    """file, offset, record (variant) of lines that are JSON objects; others are left out."""
    parsed = lines.select("file", "offset", F.try_parse_json(F.trim("value")).alias("record"))
    return parsed.filter("record is not null").filter(F.schema_of_variant("record").startswith("OBJECT"))


def jsonl_tail(spark: SparkSession, path: str, tail_bytes: int = TAIL_BYTES, suffix: str = ".jsonl") -> DataFrame:
    """The records in the last bytes of each file; the first line is left out where a file is longer."""
    spark.dataSource.register(Tail)
    return records(spark.read.format("tail").option("tailBytes", tail_bytes).option("suffix", suffix).load(path))


def jsonl_stream(spark: SparkSession, path: str, tail_bytes: int = TAIL_BYTES, suffix: str = ".jsonl") -> DataFrame:
    """The same as a stream: what is appended to the files, and the tails of those it meets first."""
    spark.dataSource.register(Tail)
    return records(spark.readStream.format("tail").option("tailBytes", tail_bytes).option("suffix", suffix).load(path))
