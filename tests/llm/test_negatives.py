"""Hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, norm string, stripe string, block string, anchor string"


def brute(rows, every, positives=5, negatives=10):
    v = [(i, [int(np.floor(256 * np.float64(x))) for x in e], l) for i, e, l in rows if i is not None and l is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, e, l in {r[0]: r for r in sorted(v, key=lambda r: (str(r[2]), r[1]), reverse=True)}.values():
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), j, m == l) for j, f, m in v if j != i)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            inside = [(t, n) for t, n, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, p, k, n, -s, -t) for k, (t, n) in enumerate(inside, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 4) for r in rows], SCHEMA)


def mined(df, every, **more):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % every == 0, **more).collect())


@pytest.mark.parametrize("scale, sizes", [(1.0, {}), (1.0, {"stripe_rows": 37, "block_rows": 5}), (3000.0, {"stripe_rows": 150, "block_rows": 16})])
def test_negatives_equal_brute_force(spark, monkeypatch, scale, sizes):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(1)
    rows = [(int(i), (scale * rng.exponential() ** 2 * (rng.normal(size=8) + 0.7)).tolist(), int(rng.choice([0, 0, 0, 1, 2, 3]))) for i in rng.permutation(400)]
    got = mined(frame(spark, rows), 9, **sizes)
    assert len(got) > 500 and got == brute(rows, 9)


def test_ties_repeats_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(0, 2)) for _ in range(4)], rng.randint(0, 2)) for i in range(120)]
    rows += [(500, None, 1), (501, [], 1), (502, [1.0, nan, 0.0, 0.0], 1), (503, [inf, 0.0, 0.0, 0.0], 1), (504, [1.0, None, 0.0, 0.0], 1), (505, [1.0] * 4, None), (None, [1.0] * 4, 1), (510, [0.0] * 4, 1)]
    plain = brute(rows, 10)
    assert mined(frame(spark, rows), 10, stripe_rows=20, block_rows=3) == plain and len(plain) > 300
    more = rows + [(600, [1.0] * 3, 1), (601, [1e9] * 4, 1)]  # an uncommon dimension, scores beyond 64 bits
    assert mined(frame(spark, more), 10) == plain
    twice = [r for r in rows if r[0] == 33] * 2 + [r for r in rows if r[0] == 40] + [(50, [2.0] * 4, 2)] + rows
    assert mined(frame(spark, twice), 10) == brute(twice, 10)


def test_scores_that_doubles_do_not_hold(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 1e5 + 1e5).tolist(), i % 3) for i in range(120)]
    assert mined(frame(spark, rows), 10) == brute(rows, 10)
    assert max(r[4] for r in brute(rows, 10)) > 1 << 53


def test_nothing_to_mine(spark):
    assert mined(frame(spark, []), 10) == []
    assert mined(frame(spark, [(1, [1.0], 1), (3, [1.0], 2)]), 10) == []  # no anchor
    assert mined(frame(spark, [(10, [1.0], 1), (3, [1.0], 2)]), 10) == []  # no positive
    assert mined(frame(spark, [(10, [1.0], 1), (3, [1.0], 1)]), 10) == []  # no negative
    assert mined(frame(spark, [(10, [0.0], 1), (3, [1.0], 1), (4, [5.0], 2)]), 10) == [(10, 3, 1, 4, 0, 0)]


def test_buckets_that_cannot_reach_a_window_are_not_read(monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 10)
    x = np.concatenate([np.full((30, 2), 100.0), np.full((970, 2), 1.0)])
    read = []
    allowed = lambda v, rows: read.append(len(rows)) or np.ones((len(v), len(rows)), dtype=bool)
    ids = np.arange(1000)
    _, rows, _ = hard_negatives.best(np.array([[1.0, 1.0]]), np.array([0]), np.array([50.0]), np.array([1e9]), allowed, x, ids, 40)
    assert sorted(rows) == list(range(30)) and sum(read) == 30  # the window's lower limit
    read.clear()
    _, rows, _ = hard_negatives.best(np.array([[1.0, 1.0]]), np.array([0]), np.array([-1e9]), np.array([1e9]), allowed, x, ids, 7)
    assert rows.tolist() == list(range(7)) and sum(read) == 30  # the running 7th score
