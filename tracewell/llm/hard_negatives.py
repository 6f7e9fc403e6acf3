"""Hard negatives by norm-bucketed search: candidates by falling norm, buckets pruned by the Cauchy-Schwarz bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewell.llm.store import buckets_for, written

#: A task compares a block of anchors with a stripe of candidates, each of at most so many bytes of doubles; buckets are parts of a stripe.
BLOCK_BYTES, STRIPE_BYTES = 1 << 20, 32 << 20
BUCKET_ROWS = 512
#: Candidates of a stripe where there are tasks enough, and the most tasks; more groups share them.
LEAST_ROWS, TASKS = 4096, 100_000
#: A table of blocks or labels with at most so many rows is broadcast (16 bytes a row), a larger one is joined by shuffle.
SMALL = 1 << 20
SCALE = 256
#: Sums of products below 2**53 are exact in doubles; below 2**56 a hundredfold score fits 64 bits.
EXACT, LARGEST = 1 << 53, 1 << 56
SLACK = 1 + 1e-9
FOUND = "anchor_id bigint, place int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def sound(column: str) -> Column:
    """True where a vector is neither null nor empty and all its components are finite and small enough for 64-bit scores."""
    most = F.sqrt(F.lit(float(LARGEST)) / F.greatest(F.size(column), F.lit(1))) / SCALE - 1
    return F.coalesce((F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > most)), F.lit(False))


def norm(column: str) -> Column:
    """Length of the vector of the components floor(256 * x)."""
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(2.0))))


def whole(a: pd.Series, x: pd.Series, d: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 * x) of the components of both: doubles where all inner products are exact in them, else 64-bit numbers."""
    both = [np.floor(SCALE * np.stack(v.to_numpy()).astype(np.float64)) for v in (a, x)]
    exact = d * np.abs(both[0]).max() * np.abs(both[1]).max() < EXACT
    return tuple(v if exact else v.astype(np.int64) for v in both)


def buckets(x: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(rows, longest norm) of each bucket, by falling norm."""
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -length))
    for first in range(0, len(order), BUCKET_ROWS):
        yield order[first : first + BUCKET_ROWS], length[order[first]]


def best(asked: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: Callable, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, row, score) of the first ``k`` allowed rows of each window: scores from ``low`` to ``high``, high ones first, then small ids.

    Window w belongs to the vector ``asked[owner[w]]``; ``allowed(vectors, rows)`` tells which rows a vector may have. A
    bucket is left out for a window when no vector of its longest norm can reach the window's lower limit or its k-th
    score so far.
    """
    length = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1))[owner]
    least = low.copy()  # what a further row has to reach
    window, row, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=asked.dtype)
    for rows, longest in buckets(x, ids):
        reached = np.flatnonzero(length * longest * SLACK + 1e-6 >= least)
        if not len(reached):
            break  # all further buckets are shorter
        vectors, place = np.unique(owner[reached], return_inverse=True)
        products, fits = asked[vectors] @ x[rows].T, allowed(vectors, rows)
        for first in range(0, len(reached), 4 * BUCKET_ROWS):
            some, at = reached[first : first + 4 * BUCKET_ROWS], place[first : first + 4 * BUCKET_ROWS]
            s = products[at]
            i, j = np.nonzero(fits[at] & (s >= least[some, None]) & (s <= high[some, None]))
            if not len(i):
                continue
            touched = np.zeros(len(owner), dtype=bool)
            touched[some[i]] = True
            old = touched[window]
            w, r, v = (np.concatenate(p) for p in ((window[old], some[i]), (row[old], rows[j]), (score[old], s[i, j])))
            order = np.lexsort((ids[r], -v, w))
            w, r, v = w[order], r[order], v[order]
            begin = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            rank = np.arange(len(w)) - np.repeat(begin, np.diff(np.append(begin, len(w))))
            least[w[rank == k - 1]] = v[rank == k - 1]
            stay = rank < k
            window, row, score = (np.concatenate(p) for p in ((window[~old], w[stay]), (row[~old], r[stay]), (score[~old], v[stay])))
    return window, row, score


def hinted(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= SMALL else small


def numbers(count: Column | int) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.lit(count) if isinstance(count, int) else count) - 1))


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), stripe_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    ``vectors`` has (vec_id, embedding, label), ``anchors`` is a condition on its rows. A score is the inner product of the
    vectors with floor(256 * x) for each component x. Positives are an anchor's ``positives`` best other rows of its label;
    negatives the ``negatives`` best rows of other labels with a score between ``low`` and ``high`` (numerator, denominator)
    of the positive's. Ties go to the smaller id; all rows are given where there are fewer.

    Rows with a null id or label, a null or empty vector, one of an uncommon dimension, null or non-finite components, or
    components so large that a hundredfold score might not fit 64 bits (beyond 131,000 with 64 components) take no part.
    Zero vectors do. Rows with the anchor's id are neither its positives nor negatives; of anchors with one id that
    with the least label and vector counts; other repeated rows count each.

    Blocks of anchors meet stripes of candidates, so candidates are copied once for each block that they can reach: those
    whose norm can't reach the least lower limit in a block aren't sent to it.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound("embedding"))
    d, n = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first() or (1, 0)
    rows = rows.where(F.size("embedding") == d)
    most = stripe_rows or max(1, STRIPE_BYTES // (8 * d))
    stripes = max(buckets_for(n, most), min(buckets_for(n, min(most, LEAST_ROWS)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    block_rows = block_rows or max(1, BLOCK_BYTES // (8 * d))
    # candidates are dealt in turn, since a hash of ids would put repeated rows together
    candidates = rows.select("vec_id", "embedding", "label", norm("embedding").alias("norm"), (F.monotonically_increasing_id() % stripes).cast("int").alias("stripe"))
    asked = written(rows.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*"), "negatives-anchors")
    hashed = F.xxhash64("vec_id")

    # positives: blocks of anchors of one label against that label's rows in each stripe
    per_label = written(asked.groupBy("label").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.count("*").alias("n")), "negatives-labels")
    labels, n_asked, label_blocks = per_label.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    per_label = hinted(per_label.drop("n"), labels)
    own = candidates.drop("norm").join(per_label, "label").withColumn("block", numbers(F.col("blocks"))).drop("blocks")
    ask = asked.join(per_label, "label").withColumn("block", F.pmod(hashed, F.col("blocks")).cast("int")).withColumn("stripe", numbers(stripes)).drop("blocks")

    def positive(ask: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(own):
            return pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []})
        names, ids = ask["vec_id"].to_numpy(), own["vec_id"].to_numpy()
        a, x = whole(ask["embedding"], own["embedding"], d)
        limit = np.full(len(a), LARGEST, dtype=a.dtype)
        w, r, s = best(a, np.arange(len(a)), -limit, limit, lambda v, at: names[v][:, None] != ids[at], x, ids, positives)
        return pd.DataFrame({"anchor_id": names[w], "positive_id": ids[r], "positive_score": s.astype(np.int64)})

    keys, tasks = ("label", "block", "stripe"), max(1, min(stripes * label_blocks, TASKS))
    pairs = ask.repartition(tasks, *keys).groupBy(*keys).cogroup(own.repartition(tasks, *keys).groupBy(*keys))
    found = pairs.applyInPandas(positive, "anchor_id bigint, positive_id bigint, positive_score bigint")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = found.withColumn("place", place).where(F.col("place") <= positives)

    # negatives: blocks of anchors with their windows against the rows in each stripe that can reach a window of the block
    blocks = buckets_for(n_asked, block_rows)
    windows = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("windows"), F.min("positive_score").alias("least"))
    ask = asked.join(windows, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    need = F.coalesce(F.try_divide(F.col("least") * (low[0] / low[1]), norm("embedding")), F.lit(0.0))
    ask = written(ask.withColumn("block", F.pmod(hashed, F.lit(blocks)).cast("int")).withColumn("need", need), "negatives-windows")
    needs = hinted(ask.groupBy("block").agg(F.min("need").alias("need")), blocks)
    own = candidates.withColumn("block", numbers(blocks)).join(needs, "block").where(F.col("norm") * SLACK >= F.col("need")).drop("norm", "need")
    ask = ask.drop("need", "least").withColumn("stripe", numbers(stripes))

    def negative(ask: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(own):
            return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
        names, ids, kind, kinds = ask["vec_id"].to_numpy(), own["vec_id"].to_numpy(), ask["label"].to_numpy(), own["label"].to_numpy()
        a, x = whole(ask["embedding"], own["embedding"], d)
        owner = np.repeat(np.arange(len(ask)), [len(w) for w in ask["windows"]])
        at, positive_ids, scores = (np.array([w[c] for ws in ask["windows"] for w in ws], dtype=np.int64) for c in ("place", "positive_id", "positive_score"))
        bounds = -(-low[0] * scores // low[1]), high[0] * scores // high[1]  # the whole numbers within
        allowed = lambda v, rows: (kind[v][:, None] != kinds[rows]) & (names[v][:, None] != ids[rows])
        w, r, s = best(a, owner, *(b.astype(a.dtype) for b in bounds), allowed, x, ids, negatives)
        return pd.DataFrame({"anchor_id": names[owner[w]], "place": at[w], "positive_id": positive_ids[w], "positive_score": scores[w], "negative_id": ids[r], "negative_score": s.astype(np.int64)})

    keys, tasks = ("block", "stripe"), max(1, min(stripes * blocks, TASKS))
    pairs = ask.repartition(tasks, *keys).groupBy(*keys).cogroup(own.repartition(tasks, *keys).groupBy(*keys))
    found = pairs.applyInPandas(negative, FOUND)
    rank = F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
