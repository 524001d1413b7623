"""Lines of text files as a stream whose micro-batches are bounded in bytes, within files too.

An offset is a place in a list of files: (number of the file, byte). A batch takes so many
bytes from there on, whatever files they lie in, in ranges that tasks read by themselves;
a line belongs to the range that its first byte lies in. The list of files is kept in a
folder: a file that appears gets the next number, so files may have any names and times.
Files are whole when they appear and don't change.

Paths are those of pyarrow's file systems: local or mounted paths, file:, s3:, gs:, hdfs:.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a task, and of one piece that it reads at a time.
PART, PIECE = 16 << 20, 1 << 20
#: seq is the number of the file times this, and the byte where the line starts.
FILE = 1 << 40


@dataclass
class Range(InputPartition):
    """Bytes of a file."""

    path: str
    file: int
    low: int
    high: int


def lines_of(stream: pa.NativeFile, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """Start and content of the lines that start in [low, high); ends of lines are \\n or \\r\\n."""
    at = max(0, low - 1)
    stream.seek(at)
    rest, skip, start = b"", low > 0, at
    while start < high or skip:
        piece = stream.read(PIECE)
        if not piece:
            break
        rest += piece
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if skip:  # the end of a line that started before
                skip = False
            elif start < high:
                yield start, line.removesuffix(b"\r")
            start += len(line) + 1
    if rest and not skip and start < high:  # the last line of a file that doesn't end with one
        yield start, rest.removesuffix(b"\r")


class LineReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.log = options["path"], options["log"]
        self.limit, self.part = int(options["bytesperbatch"]), int(options.get("bytesperpartition", PART))
        if self.limit < 1 or self.part < 1:
            raise ValueError("bytesPerBatch and bytesPerPartition are at least 1")
        self.files: list[list] | None = None  # path and size
        self.last = (0, 0)

    def _load(self) -> None:
        if self.files is not None:
            return
        self.files, (where, root) = [], fs.FileSystem.from_uri(self.log)
        where.create_dir(root)
        names = sorted(f.path for f in where.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("files-"))
        for name in names:
            with where.open_input_stream(name) as f:
                self.files += json.loads(f.read())
        if where.get_file_info(f"{root}/last.json").type == fs.FileType.File:
            with where.open_input_stream(f"{root}/last.json") as f:
                self.last = tuple(json.loads(f.read()))

    def _put(self, name: str, what: list) -> None:
        """Whole or not at all: written beside, and moved."""
        where, root = fs.FileSystem.from_uri(self.log)
        with where.open_output_stream(f"{root}/_{name}") as f:
            f.write(json.dumps(what).encode())
        where.move(f"{root}/_{name}", f"{root}/{name}")

    def _find(self) -> None:
        """Put new files on the list."""
        where, root = fs.FileSystem.from_uri(self.path)
        known = {p for p, _ in self.files}
        found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
        new = sorted([f.path, f.size] for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.path not in known)
        if new:
            self._put(f"files-{len(self.files):012d}.json", new)
            self.files += new

    def initialOffset(self) -> dict:
        return {"file": 0, "at": 0}

    def latestOffset(self) -> dict:
        """The place a batch further than the last time. It is put down before Spark learns of it, so a stream that is started again never goes back."""
        self._load()
        self._find()
        (i, at), left = self.last, self.limit
        while left and i < len(self.files):
            step = min(left, self.files[i][1] - at)
            at, left = at + step, left - step
            if at == self.files[i][1]:
                i, at = i + 1, 0
        if (i, at) != self.last:
            self._put("last.json", [i, at])
            self.last = (i, at)
        return {"file": i, "at": at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self._load()
        out = []
        for i in range(start["file"], min(end["file"] + 1, len(self.files))):
            path, size = self.files[i]
            low, high = start["at"] if i == start["file"] else 0, end["at"] if i == end["file"] else size
            out += [Range(path, i, a, min(a + self.part, high)) for a in range(low, high, self.part)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path)
        seq, value, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(value, pa.string())], ["seq", "value"])

        with where.open_input_file(partition.path) as f:
            for at, line in lines_of(f, partition.low, partition.high):
                seq.append(partition.file * FILE + at)
                value.append(line.decode("utf-8", "replace"))
                size += len(line)
                if size >= PIECE:
                    yield batch()
                    seq, value, size = [], [], 0
        if seq:
            yield batch()


class BoundedLines(DataSource):
    """spark.readStream.format("bounded_lines") with options path, log (a shared folder of its own), bytesPerBatch, bytesPerPartition: seq and value."""

    @classmethod
    def name(cls) -> str:
        return "bounded_lines"

    def schema(self) -> str:
        return "seq long, value string"

    def streamReader(self, schema) -> LineReader:
        return LineReader({k.lower(): v for k, v in self.options.items()})


def bounded_lines(spark: SparkSession, path: str, log: str, bytes_per_batch: int, bytes_per_partition: int = PART) -> DataFrame:
    """seq and value of the lines of a folder's files as a stream, so many bytes to a batch. Run it with streaming.online.run_through, or with any trigger but availableNow, which Spark makes one batch of."""
    spark.dataSource.register(BoundedLines)
    options = {"path": path, "log": log, "bytesPerBatch": str(bytes_per_batch), "bytesPerPartition": str(bytes_per_partition)}
    return spark.readStream.format("bounded_lines").options(**options).load()
