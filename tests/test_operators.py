import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators import joins, windows


@pytest.mark.parametrize("which", ("asof_forward", "neighbours"))
def test_one_key_with_many_rows_takes_linear_time(spark, which):
    rows = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("ts"), (F.col("id") % 3 == 0).alias("hit"))
    if which == "asof_forward":
        out = joins.asof_forward(rows.where("not hit"), rows.where("hit").withColumn("r", F.col("ts")), ["k"], "ts", "r").agg(F.sum("next_r"))
        expected = sum(-(-i // 3) * 3 for i in range(100_000) if i % 3 and -(-i // 3) * 3 < 100_000)
    else:
        out = windows.neighbours(rows, ["k"], "ts", F.col("hit")).agg(F.sum("next_index"))
        expected = sum((i // 3 + 1) * 3 for i in range(100_000) if (i // 3 + 1) * 3 < 100_000)
    began = time.time()
    assert out.first()[0] == expected
    assert time.time() - began < 10


def test_asof_takes_the_first_at_the_same_time(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 1), (1, 20)], "k int, ts int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 10, "b"), (3, 7, "c")], "k int, ts int, r string")
    got = {(r["k"], r["ts"]): (r["next_r"], r["next_ts"]) for r in joins.asof_forward(left, right, ["k"], "ts", "r").collect()}
    assert got == {(1, 5): ("a", 5), (1, 9): ("b", 10), (2, 1): (None, None), (1, 20): (None, None)}


def test_ratio_to_max(spark):
    df = spark.createDataFrame([("a", 2), ("a", 4), ("b", 0)], "k string, v int")
    assert {(r["k"], r["v"]): r["x"] for r in windows.ratio_to_max(df, ["k"], "v", "x").collect()} == {("a", 2): 0.5, ("a", 4): 1.0, ("b", 0): 0.0}


def test_actions_merge_reads_and_drop_repeated_searches(spark):
    rows = [(1, "read", "a"), (2, "read", None), (3, "read", "b"), (4, "read", "a"), (5, "search", None), (6, "search", None), (7, "edit", "a"), (8, "edit", "a")]
    df = spark.createDataFrame([(1, *r) for r in rows], "s int, o int, kind string, file string")
    got = [(r["kind"], r["files"]) for r in windows.actions(df, ["s"], ["o"], "kind", "file").orderBy("at").collect()]
    assert [k for k, _ in got] == ["read", "search", "edit", "edit"] and got[0][1] == ["a", "b"]
