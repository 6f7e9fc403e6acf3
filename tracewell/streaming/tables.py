"""Tables that a stream keeps up to date: rows lie in buckets by key, a batch writes the buckets it changes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.incremental import upsert

BUCKETS = 64


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, through Spark's own access to the store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions."""
    store, at = _folder(spark, f"{path}/versions")
    found = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    return sorted(int(name) for name in found if name.isdigit())


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    """What a version consists of: {"format", "buckets", "schema", "at": {bucket: version that wrote it}}."""
    return json.loads(spark.read.text(f"{path}/versions/{version:012d}", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, version: int, body: dict) -> None:
    """Write a manifest beside its place and move it there, so that readers see it whole or not at all."""
    jvm = spark.sparkContext._jvm
    store, place = _folder(spark, f"{path}/versions/{version:012d}")
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/_{version:012d}")
    out = store.create(beside, True)
    out.write(json.dumps(body).encode())
    out.close()
    store.delete(place, False)
    if not store.rename(beside, place):
        raise OSError(f"version {version} of {path} could not be published")


def _read(spark: SparkSession, path: str, body: dict, buckets: list[str]) -> DataFrame:
    paths = [f"{path}/rows/version={body['at'][b]:012d}/bucket={b}" for b in buckets]
    return spark.read.schema(body["schema"]).parquet(*paths) if paths else spark.createDataFrame([], body["schema"])


def current(spark: SparkSession, path: str, format: str = "1", version: int | None = None) -> DataFrame | None:
    """The rows of the newest version, or of another one; None where there is none, or the newest is of another format (K4)."""
    found = [v for v in versions(spark, path) if version is None or v == version]
    if not found:
        return None
    body = manifest(spark, path, found[-1])
    return _read(spark, path, body, sorted(body["at"], key=int)) if body["format"] == format else None


def merged_into(path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, buckets: int = BUCKETS, format: str = "1") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges each batch into the table at ``path``, whose rows are its newest ones by ``keys``.

    A batch reads and writes the buckets that its keys lie in; all others stay where they are. The new version counts from
    the moment its manifest stands in its place: a batch that fails before leaves the version before it, and one that is
    run again starts from that. ``merge(old, new)`` takes the rows of the touched buckets; by default new rows replace old
    ones of their key. A table of another ``format`` is built anew.
    """

    def bucket() -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < number]
        body = manifest(spark, path, before[-1]) if before else None
        if body and (body["format"] != format or body["buckets"] != buckets):
            body = None
        known = body["at"] if body else {}
        new = batch.withColumn("__bucket", bucket()).persist()
        try:
            touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())  # at most one row for each bucket
            rows = new.drop("__bucket")
            if body:
                rows = (merge or (lambda a, b: upsert(a, b, keys)))(_read(spark, path, body, [str(b) for b in touched if str(b) in known]), rows)
            rows.withColumn("bucket", bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={number:012d}")
            written = _folder(spark, f"{path}/rows/version={number:012d}")
            full = {f.getPath().getName().removeprefix("bucket=") for f in written[0].listStatus(written[1]) if f.getPath().getName().startswith("bucket=")}
            at = {b: v for b, v in known.items() if int(b) not in touched} | {b: number for b in full}
            _publish(spark, path, number, {"format": format, "buckets": buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "at": at})
        finally:
            new.unpersist()

    return run


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` versions and the buckets that only they used; how many folders went."""
    all_ = versions(spark, path)
    kept = all_[-keep:]
    used = {(v, b) for n in kept for b, v in manifest(spark, path, n)["at"].items()}
    gone = 0
    for n in all_[:-keep] if keep else all_:
        store, at = _folder(spark, f"{path}/versions/{n:012d}")
        store.delete(at, False)
    store, rows = _folder(spark, f"{path}/rows")
    for version in store.listStatus(rows) if store.exists(rows) else []:
        n = int(version.getPath().getName().removeprefix("version="))
        if kept and n > kept[-1]:
            continue  # being written
        for bucket in store.listStatus(version.getPath()):
            name = bucket.getPath().getName()
            if name.startswith("bucket=") and (n, name.removeprefix("bucket=")) not in used:
                store.delete(bucket.getPath(), True)
                gone += 1
    return gone
