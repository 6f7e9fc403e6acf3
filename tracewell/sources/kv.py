"""A source of key/value tables in SQLite files that executors can open by path: a task for each range of rows, keys looked up in the files.

``stores.rows`` reads the same through Spark's own access to any store, but takes each file whole, below 2 GB.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from tracewell.sources import ranges

SCHEMA = "path string, key string, value binary"
_ARROW = pa.schema([("path", pa.string()), ("key", pa.string()), ("value", pa.binary())])
#: Rows of a task, and bytes of values in a batch.
ROWS, BATCH = 200_000, 8 << 20


@dataclass
class Rows(InputPartition):
    path: str
    first: int | None
    last: int | None


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path.removeprefix('file://').removeprefix('file:'))}?mode=ro&immutable=1", uri=True)


def after(prefix: str) -> str | None:
    """The smallest text that sorts behind all texts with the prefix; None where there is none."""
    while prefix and ord(prefix[-1]) == 0x10FFFF:
        prefix = prefix[:-1]
    if not prefix:
        return None
    last = ord(prefix[-1]) + 1
    return prefix[:-1] + chr(0xE000 if last == 0xD800 else last)


class KvReader(DataSourceReader):
    """Reads (path, key, value) of a table; an equal key or a prefix of it is pushed into the query of each file."""

    def __init__(self, options: dict):
        self.root, self.table = options["path"], options["table"]
        self.key, self.value, self.suffix = options.get("key", "key"), options.get("value", "value"), options.get("suffix", ".db")
        self.rows = int(options.get("rows", ROWS))
        self.bounds: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("key",):
                stop = after(f.value)
                self.bounds += [(">=", f.value)] + ([("<", stop)] if stop else [])
            elif isinstance(f, EqualTo) and f.attribute == ("key",):
                self.bounds.append(("=", f.value))
            else:
                yield f  # left to Spark

    def partitions(self) -> list[Rows]:
        """Ranges of row numbers of each file; files without the table, and files that aren't SQLite, have none."""
        out = []
        for path, _ in ranges.listing(self.root, self.suffix):
            db = connect(path)
            try:
                if not db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (self.table,)).fetchone():
                    continue
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
                if low is not None:
                    out += [Rows(path, at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]
            except sqlite3.OperationalError as e:
                if "rowid" not in str(e):
                    raise
                out.append(Rows(path, None, None))  # a table without row numbers
            except sqlite3.DatabaseError:
                continue
            finally:
                db.close()
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Rows):
            return
        where = [f'"{self.key}" {op} ?' for op, _ in self.bounds]
        given = [v for _, v in self.bounds]
        if partition.first is not None:
            where.append("rowid BETWEEN ? AND ?")
            given += [partition.first, partition.last]
        query = f'SELECT CAST("{self.key}" AS TEXT), CAST("{self.value}" AS BLOB) FROM "{self.table}"' + (" WHERE " + " AND ".join(where) if where else "")
        db = connect(partition.path)
        try:
            keys, values, size = [], [], 0
            for key, value in db.execute(query, given):
                keys.append(key)
                values.append(value)
                size += len(value or b"") + 100
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(keys)), pa.array(keys), pa.array(values, type=pa.binary())], schema=_ARROW)
                    keys, values, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(keys)), pa.array(keys), pa.array(values, type=pa.binary())], schema=_ARROW)
        finally:
            db.close()


class KvStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kv_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KvReader:
        return KvReader(self.options)


def rows(spark: SparkSession, path: str, table: str, key: str = "key", value: str = "value", suffix: str = ".db", rows: int = ROWS) -> DataFrame:
    """(path, key, value) of a table in each SQLite file below ``path``, values as bytes.

    A filter on ``key`` by equality or prefix becomes part of the files' queries, which use their index of keys. Files
    of any size, on a file system that driver and executors have under the same path.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KvStore)
    reader = spark.read.format("kv_store").option("table", table).option("key", key).option("value", value).option("suffix", suffix).option("rows", rows)
    return reader.load(path)
