"""Logs in byte ranges and splits, and files that grow under a stream."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from test_sessions import AGENT, LOG, OTHER

from tracewell.plans import sessions
from tracewell.sources import logs, ranges


def plain_lines(data):
    at, out = 0, []
    for line in data.split(b"\n"):
        if line.strip():
            out.append((at, line.decode("utf-8", errors="replace")))
        at += len(line) + 1
    return out


def test_ranges_read_each_line_once(tmp_path):
    rng = random.Random(1)
    for n, chunk in enumerate((1 << 20, 7)):
        ranges.CHUNK = chunk
        try:
            for size in (1, 2, 3, 10, 64, 1000):
                data = b"\n".join(rng.choice([b"", b"x", b"ab" * rng.randint(1, 40), "é🎉".encode() * 5, b" \r"]) for _ in range(60)) + rng.choice([b"", b"\n"])
                path = tmp_path / f"{n}-{size}.jsonl"
                path.write_bytes(data)
                got = [(a, r) for part in ranges.cut(str(path), 0, len(data), size) for b in ranges.batches(part) for a, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                assert got == plain_lines(data)
                assert ranges.last_line_end(str(path), len(data)) == data.rfind(b"\n") + 1
        finally:
            ranges.CHUNK = 1 << 20


@pytest.fixture
def root(tmp_path):
    (tmp_path / "one" / "subagents").mkdir(parents=True)
    for path, rows in ((tmp_path / "one.jsonl", LOG), (tmp_path / "two.jsonl", OTHER), (tmp_path / "one" / "subagents" / "agent-7.jsonl", AGENT)):
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return tmp_path


def test_sessions_are_the_same_in_splits_and_ranges(spark, root):
    def both(events):
        return sorted(map(str, sessions.scan(events, "/home/me").collect())), sorted(map(str, sessions.scenes(events, "/home/me").collect()))

    want = both(logs.events(spark, str(root)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert logs.raw_lines(spark, str(root)).select("line.split").distinct().count() > 5
        assert both(logs.events(spark, str(root))) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert both(logs.parsed(ranges.lines(spark, str(root), range_bytes=100))) == want
    assert both(logs.saved(logs.events(spark, str(root)), str(root / "table"))) == want


def test_a_large_file_in_splits_keeps_its_order(spark, tmp_path):
    with open(tmp_path / "s.jsonl", "w") as f:
        for n in range(200_000):
            f.write(json.dumps({"n": n, "pad": "p" * (n % 90)}) + "\n" * (1 + n % 2))
    number = F.get_json_object("raw", "$.n").cast("long")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = logs.numbered(logs.raw_lines(spark, str(tmp_path)))
        assert rows.where(number != F.col("line_no")).count() == 0 and rows.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    read = ranges.lines(spark, str(tmp_path), range_bytes=1 << 20)
    assert read.rdd.getNumPartitions() == -(-os.path.getsize(tmp_path / "s.jsonl") // (1 << 20))
    inorder = [r[0] for r in read.orderBy("path", "line").select(number).collect()]
    assert inorder == list(range(200_000))


def test_a_stream_reads_what_is_appended(spark, tmp_path):
    logs_, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    logs_.mkdir()

    def run():
        stream = ranges.growing(spark, str(logs_), range_bytes=40)
        query = stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return sorted((os.path.basename(r["path"]), r["line"], r["raw"]) for r in spark.read.parquet(out).collect())

    def lines(name, first, last):
        return "".join(f'{{"f": "{name}", "n": {n}}}\n' for n in range(first, last))

    (logs_ / "a.jsonl").write_text(lines("a", 0, 20))
    (logs_ / "b.jsonl").write_text(lines("b", 0, 3) + '{"f": "b", "cut')
    first = run()
    assert len(first) == 23 and not any("cut" in r[2] for r in first)
    with open(logs_ / "a.jsonl", "a") as f:
        f.write(lines("a", 20, 25))
    with open(logs_ / "b.jsonl", "a") as f:
        f.write('": 1}\n')
    (logs_ / "c.jsonl").write_text(lines("c", 0, 2))
    second = run()  # a new query from the checkpoint
    assert len(second) == 23 + 5 + 1 + 2 and set(first) < set(second)
    assert [r[2] for r in second if "cut" in r[2]] == ['{"f": "b", "cut": 1}']
    assert run() == second  # nothing new
    (logs_ / "c.jsonl").write_text(lines("d", 0, 1))  # another file of that name, shorter
    third = run()
    assert len(third) == len(second) + 1 and ("c.jsonl", 0, '{"f": "d", "n": 0}') in third


def test_a_running_stream_follows_its_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    path, seen = tmp_path / "logs" / "a.jsonl", []
    path.write_text("1\n2\n")
    query = ranges.growing(spark, str(tmp_path / "logs")).writeStream.foreachBatch(lambda df, n: seen.append(sorted(r["raw"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        with open(path, "a") as f:
            f.write("3\n4")
        query.processAllAvailable()
        with open(path, "a") as f:
            f.write("5\n")
        query.processAllAvailable()
    finally:
        query.stop()
    assert [b for b in seen if b] == [["1", "2"], ["3"], ["45"]]
