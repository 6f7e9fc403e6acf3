"""Streams: active time under late events, and tables kept by batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import windows
from tracewell.streaming import activity, tables


def test_active_time_is_exact_for_events_out_of_order(spark, tmp_path):
    rng = random.Random(5)
    late = 30 * 60_000
    rows, t = [], 1_700_000_000_000
    for _ in range(400):
        t += rng.choice([0, 1_000, 60_000, 200_000, 600_000, 1_800_000])
        rows.append((rng.choice("abc"), t))
    arrived = sorted(rows, key=lambda r: r[1] + rng.uniform(0, late))  # never more than ``late`` behind the newest
    assert arrived != rows
    (tmp_path / "in").mkdir()
    for n in range(8):
        with open(tmp_path / "in" / f"{n}.json", "w") as f:
            f.writelines(f'{{"user": "{u}", "ms": {ms}}}\n' for u, ms in arrived[50 * n : 50 * n + 50])
        os.utime(tmp_path / "in" / f"{n}.json", (1_700_000_000 + 10 * n,) * 2)
    stream = spark.readStream.schema("user string, ms bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("at", F.timestamp_millis("ms"))
    seen = {}

    def keep(df, n):
        got = {r["user"]: r["active_ms"] for r in df.where("not closed").collect()}
        so_far = spark.createDataFrame(arrived[: 50 * n + 50], "user string, ms bigint").withColumn("at", F.timestamp_millis("ms"))
        want = {r["user"]: r["active_ms"] or 0 for r in windows.active_duration(so_far, "user", "at").collect()}
        seen[n] = all(want[u] == ms for u, ms in got.items())
        last.update(got)

    last = {}
    out = activity.active_time(stream, "user", "at", late="31 minutes", idle=None)
    query = out.writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert query.awaitTermination(300)
    assert all(seen.values()) and len(seen) >= 8
    want = windows.active_duration(spark.createDataFrame(rows, "user string, ms bigint").withColumn("at", F.timestamp_millis("ms")), "user", "at")
    assert last == {r["user"]: r["active_ms"] for r in want.collect()}


def test_an_idle_key_is_closed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(([("a", 0), ("a", 60)], [("b", 100_000)], [("b", 100_060)], [("b", 100_061)])):
        with open(tmp_path / "in" / f"{n}.json", "w") as f:
            f.writelines(f'{{"user": "{u}", "s": {1_700_000_000 + s}}}\n' for u, s in rows)
        os.utime(tmp_path / "in" / f"{n}.json", (1_700_000_000 + 10 * n,) * 2)
    stream = spark.readStream.schema("user string, s bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("s"))
    query = activity.active_time(stream, "user", "at", late="1 minute", idle="1 hour").writeStream.outputMode("update").format("memory").queryName("closed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert query.awaitTermination(300)
    assert [(r["user"], r["active_ms"]) for r in spark.table("closed").where("closed").collect()] == [("a", 60_000)]


def folders(path, number):
    return sorted(f for f in os.listdir(f"{path}/rows/version={number:012d}") if f.startswith("bucket="))


def rows_of(df):
    return {r["k"]: r["n"] for r in df.collect()}


def test_a_batch_writes_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    put = tables.merged_into(path, ["k"], buckets=64)
    frame = lambda rows: spark.createDataFrame(rows, "k bigint, n int")
    assert tables.current(spark, path) is None
    put(frame([(k, 0) for k in range(500)]), 0)
    assert rows_of(tables.current(spark, path)) == dict.fromkeys(range(500), 0)
    bucket = {r["k"]: r["b"] for r in frame([(k, 0) for k in range(500)]).select("k", F.pmod(F.xxhash64("k"), F.lit(64)).alias("b")).collect()}
    one, other = 7, next(k for k in range(500) if bucket[k] != bucket[7])
    put(frame([(one, 1), (other, 1)]), 1)
    assert folders(path, 1) == sorted({f"bucket={bucket[one]}", f"bucket={bucket[other]}"})
    want = dict.fromkeys(range(500), 0) | {one: 1, other: 1}
    assert rows_of(tables.current(spark, path)) == want
    # a batch that fails leaves the version before it, and run again starts from that
    failing = tables.merged_into(path, ["k"], merge=lambda old, new: new.withColumn("n", F.raise_error(F.lit("no")).cast("int")))
    with pytest.raises(Exception, match="no"):
        failing(frame([(one, 2)]), 2)
    assert rows_of(tables.current(spark, path)) == want and tables.versions(spark, path) == [0, 1]
    for _ in range(2):
        put(frame([(one, 2), (9999, 3)]), 2)
        assert rows_of(tables.current(spark, path)) == want | {one: 2, 9999: 3}
    put(frame([]), 3)
    other = tables.merged_into(str(tmp_path / "null"), ["k"], buckets=4)
    other(frame([(None, 1), (1, 1)]), 0)
    other(frame([(None, 2)]), 1)
    assert sorted(map(str, tables.current(spark, str(tmp_path / "null")).collect())) == ["Row(k=1, n=1)", "Row(k=None, n=2)"]
    assert rows_of(tables.current(spark, path)) == want | {one: 2, 9999: 3}
    assert rows_of(tables.current(spark, path, version=1)) == want
    assert tables.vacuum(spark, path, keep=1) > 0 and tables.versions(spark, path) == [3]
    assert rows_of(tables.current(spark, path)) == want | {one: 2, 9999: 3}
    assert tables.current(spark, path, format="2") is None


def test_merge_of_one_key_adds_up(spark, tmp_path):
    path = str(tmp_path / "t")
    put = tables.merged_into(path, ["k"], merge=lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").cast("int").alias("n")), buckets=8)
    for number, rows in enumerate(([(1, 1), (2, 2)], [(2, 3), (3, 4)], [(None, 1)], [(None, 2)])):
        put(spark.createDataFrame(rows, "k bigint, n int"), number)
    assert rows_of(tables.current(spark, path)) == {1: 1, 2: 5, 3: 4, None: 3}
