"""A source of log lines by byte ranges, and a stream that follows files as they grow.

``spark.read.format("log_ranges")`` gives (path, line, raw): each line with the byte where it begins. Large files are read
in ranges, a line by the range in which it begins. ``spark.readStream`` with the same format reads what is appended to
the files, which Spark's file source never does: its offset holds for each file the end of its last whole line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, line bigint, raw string"
_ARROW = pa.schema([("path", pa.string()), ("line", pa.int64()), ("raw", pa.string())])
#: Bytes of a range, of one read, and of lines in a batch.
RANGE, CHUNK, BATCH = 64 << 20, 1 << 20, 4 << 20
#: A file whose first bytes have changed is another file.
HEAD = 1024


@dataclass
class Range(InputPartition):
    """The lines of a file that begin from ``start`` on and before ``stop``; nothing after ``end`` is read."""

    path: str
    start: int
    stop: int
    end: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def listing(root: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files below ``root`` with the ending ``suffix``, sorted."""
    store, base = opened(root)
    info = store.get_file_info(base)
    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    lead = root[: len(root.rstrip("/")) - len(base.rstrip("/"))] if root.rstrip("/").endswith(base.rstrip("/")) else ""
    return sorted((lead + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix))


def cut(path: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(path, at, min(at + size, end), end) for at in range(start, end, size)]


def lines_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """(byte, line) of a range. A line over the range's edge belongs to the range in which it begins."""
    store, path = opened(part.path)
    with store.open_input_file(path) as file:
        at = max(part.start - 1, 0)  # a line begins here if the byte before ends one
        file.seek(at)
        skip, begin = part.start > 0, at
        held: list[bytes] = []
        while at < part.end and (begin < part.stop or skip):
            chunk = file.read(min(CHUNK, part.end - at))
            if not chunk:
                break
            first = 0
            while (stop := chunk.find(b"\n", first)) >= 0:
                if skip:
                    skip = False
                elif begin < part.stop:
                    yield begin, b"".join((*held, chunk[first:stop]))
                held, first = [], stop + 1
                begin = at + first
                if begin >= part.stop:
                    return
            if not skip:
                held.append(chunk[first:])
            at += len(chunk)
        if not skip and begin < part.stop and any(held):
            yield begin, b"".join(held)


def batches(part: Range) -> Iterator[pa.RecordBatch]:
    """Lines that aren't blank, in batches of about four megabytes."""
    lines, raw, size = [], [], 0
    for at, line in lines_of(part):
        if line.strip():
            lines.append(at)
            raw.append(line.decode("utf-8", errors="replace"))
            size += len(line)
            if size > BATCH:
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(lines)), pa.array(lines), pa.array(raw)], schema=_ARROW)
                lines, raw, size = [], [], 0
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(lines)), pa.array(lines), pa.array(raw)], schema=_ARROW)


def head(path: str, n: int) -> str:
    """Digest of a file's first ``n`` bytes; of nothing where the file has gone."""
    store, name = opened(path)
    try:
        with store.open_input_file(name) as file:
            return hashlib.sha256(file.read(n)).hexdigest()
    except FileNotFoundError:
        return hashlib.sha256(b"").hexdigest()


def last_line_end(path: str, size: int) -> int:
    """The byte after the last line feed in the first ``size`` bytes."""
    store, name = opened(path)
    with store.open_input_file(name) as file:
        stop = size
        while stop > 0:
            start = max(0, stop - CHUNK)
            file.seek(start)
            at = file.read(stop - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.suffix, self.size = options["path"], options.get("suffix", ".jsonl"), int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[Range]:
        return [r for path, size in listing(self.root, self.suffix) for r in cut(path, 0, size, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition) if isinstance(partition, Range) else iter(())


class GrowingReader(DataSourceStreamReader):
    """Offsets: {path: {"end": byte after the last whole line, "head": bytes in the digest, "digest": of the first bytes}}.

    A file that got shorter or begins with other bytes is read from its start. What a range gives depends on the two offsets
    alone, so a batch that is run again reads the same bytes. The offset has an entry of 150 bytes for each file.
    """

    def __init__(self, options: dict):
        self.root, self.suffix, self.size = options["path"], options.get("suffix", ".jsonl"), int(options.get("rangebytes", RANGE))
        self.known: dict[str, tuple[int, dict]] = {}  # entries of files whose size hasn't changed

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path, size in listing(self.root, self.suffix):
            before = self.known.get(path)
            if before and before[0] == size and head(path, before[1]["head"]) == before[1]["digest"]:
                out[path] = before[1]
                continue
            end = last_line_end(path, size)
            n = min(end, HEAD)
            out[path] = {"end": end, "head": n, "digest": head(path, n)}
            self.known[path] = (size, out[path])
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, now in end.items():
            was = start.get(path)
            if was == now:
                continue
            same = was and was["end"] <= now["end"] and (was["digest"] == now["digest"] if was["head"] == now["head"] else head(path, was["head"]) == was["digest"])
            out += cut(path, was["end"] if same else 0, now["end"], self.size)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition)


class LogRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def lines(spark: SparkSession, path: str, range_bytes: int = RANGE, suffix: str = ".jsonl") -> DataFrame:
    """(path, line, raw) of all files below ``path``, blank lines left out; ``line`` is the byte where a line begins.

    For file systems that Arrow opens (local, HDFS, S3); ``logs.lines`` reads through Spark's own.
    """
    spark.dataSource.register(LogRanges)
    return spark.read.format("log_ranges").option("rangeBytes", range_bytes).option("suffix", suffix).load(path)


def growing(spark: SparkSession, path: str, range_bytes: int = RANGE, suffix: str = ".jsonl") -> DataFrame:
    """A stream of (path, line, raw): the whole lines that are appended to the files below ``path``.

    A last line without a line feed waits until it has one.
    """
    spark.dataSource.register(LogRanges)
    return spark.readStream.format("log_ranges").option("rangeBytes", range_bytes).option("suffix", suffix).load(path)
