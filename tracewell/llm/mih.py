"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.llm.store import buckets_for
from tracewell.llm.vectors import common_dimension, matrix, usable

#: Bits of a code, at least; every rotation gives one bit for each dimension.
BITS = 256
#: Bits of a substring; each substring has an index of its own.
SUBSTRING = 16
#: Rotations are learned from this many vectors at most, those with the smallest hash of their id.
SAMPLE = 4096
#: Bytes of a shard's vectors, as doubles, and queries of a block, about.
SHARD_BYTES = 16 << 20
QUERY_ROWS = 4_096
#: Queries that are probed together.
TOGETHER = 64
#: The radius widens until a shard has this many codes within it; floats then rank them. Audits widen it fourfold where that isn't enough.
RERANK = 75
#: Groups of queries by radius, queries of each that are compared with the whole shard, and the share of neighbours they must find.
GROUPS, AUDIT, RECALL = 8, 32, 0.95


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = 15, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotations side by side): iterative quantisation from several random starts."""
    mean = sample.mean(axis=0)
    x = sample - mean
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        out.append(r)
    wide = np.concatenate(out, axis=1)
    return mean, wide[:, : wide.shape[1] // SUBSTRING * SUBSTRING] if wide.shape[1] >= SUBSTRING else np.tile(wide, SUBSTRING)[:, :SUBSTRING]


def codes(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """(vectors x substrings) of 16 bits each."""
    return np.packbits((x - mean) @ rotation >= 0, axis=1).view(np.uint16)


#: The differences that a substring may have to a query's, by how many bits differ.
MASKS = [np.flatnonzero(np.bitwise_count(np.arange(1 << SUBSTRING)) == s).astype(np.uint16) for s in range(SUBSTRING + 1)]


class Index:
    """For each substring the rows of a shard sorted by its value, and where each value begins."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.rows = [np.argsort(code[:, j], kind="stable").astype(np.int32) for j in range(code.shape[1])]
        self.begin = [np.searchsorted(code[r, j], np.arange((1 << SUBSTRING) + 1)).astype(np.int32) for j, r in enumerate(self.rows)]
        #: Rows looked at so far.
        self.touched = 0

    def distance(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.code[rows] ^ queries).sum(axis=1, dtype=np.int64)

    def probed(self, queries: np.ndarray, bits: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query x row numbers, queries left out) of the buckets whose value differs in ``bits`` bits; queries whose buckets hold more rows than ``room`` are left out."""
        lows, sizes = [], []
        for j, begin in enumerate(self.begin):
            key = (queries[:, j, None] ^ MASKS[bits]).astype(np.int64)
            lows.append(begin[key])
            sizes.append(begin[key + 1] - lows[-1])
        full = sum(x.sum(axis=1) for x in sizes) > room
        out = []
        for rows, low, size in zip(self.rows, lows, sizes, strict=True):
            size[full] = 0
            flat = size.ravel()
            place = np.repeat(low.ravel() - np.concatenate(([0], np.cumsum(flat)[:-1])), flat) + np.arange(flat.sum())
            owner = np.repeat(np.arange(len(queries)), size.sum(axis=1))
            out.append(owner * len(self.code) + rows[place])
        return np.concatenate(out), full

    def nearest(self, queries: np.ndarray, least: int) -> list[np.ndarray]:
        """For each query the rows of all codes within the smallest radius that holds ``least`` codes, or of all.

        A code within radius r shares a substring to within r // substrings bits (pigeonhole), so the buckets whose values
        differ in s = 0, 1, 2, ... bits are looked up until the codes within substrings * (s + 1) - 1 bits, which then
        are all known, are enough. Where the buckets would hold half as many rows as there are, all codes are compared.
        """
        n, m = self.code.shape
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(queries)

        def keep(k: int, rows: np.ndarray, distance: np.ndarray) -> None:
            if len(rows) > least:
                rows = rows[distance <= np.partition(distance, least - 1)[least - 1]]
            out[k] = np.sort(rows)

        def scan(k: int) -> None:
            self.touched += n
            keep(k, np.arange(n), self.distance(np.arange(n), queries[k]))

        for low in range(0, len(queries), TOGETHER):
            open_ = np.arange(low, min(low + TOGETHER, len(queries)))
            known, distance, seen = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(open_), dtype=np.int64)
            for s in range(SUBSTRING + 1):
                if len(MASKS[s]) * m > n // 2 or not len(open_):
                    break
                fresh, full = self.probed(queries[open_], s, n // 2 - seen)
                for k in open_[full]:
                    scan(k)
                seen += np.bincount(fresh // n, minlength=len(open_))
                self.touched += len(fresh)
                fresh = np.setdiff1d(fresh, known)
                known, distance = np.concatenate((known, fresh)), np.concatenate((distance, self.distance(fresh % n, queries[open_[fresh // n]])))
                order = np.argsort(known)
                known, distance = known[order], distance[order]
                owner = known // n
                done = (np.bincount(owner, weights=distance <= m * (s + 1) - 1, minlength=len(open_)) >= least) & ~full
                edges = np.searchsorted(owner, np.arange(len(open_) + 1))
                for k in np.flatnonzero(done):
                    part = slice(edges[k], edges[k + 1])
                    keep(open_[k], known[part] % n, distance[part])
                left = ~done & ~full
                stay = left[owner]
                number = np.cumsum(left) - 1
                known, distance, open_, seen = number[owner[stay]] * n + known[stay] % n, distance[stay], open_[left], seen[left]
            for k in open_:
                scan(k)
        return out


def ranked(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, vector: np.ndarray, name: object, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the ``k`` nearest of ``rows``, without the one called ``name``."""
    rows = rows[ids[rows] != name]
    score = np.sqrt(((x[rows] - vector) ** 2).sum(axis=1))
    best = np.lexsort((ids[rows], score))[:k]
    return rows[best], score[best]


def neighbours(x: np.ndarray, ids: np.ndarray, q: np.ndarray, names: list, mean: np.ndarray, rotation: np.ndarray, k: int, rerank: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, distances) for each query, nearest first.

    Queries are grouped by the radius that holds ``rerank`` codes, which is small in dense places. Some of each group are
    compared with all rows; where they find too few of their neighbours, the group ranks four times as many codes, up to all.
    """
    index, asked = Index(codes(x, mean, rotation)), codes(q, mean, rotation)
    all_rows = np.arange(len(x))

    def found(which: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        rows = index.nearest(asked[which], least + 1) if least < len(x) else [all_rows] * len(which)
        for i, r in zip(which, rows, strict=True):
            radius[i] = index.distance(r, asked[i]).max(initial=0)
        return [ranked(x, ids, r, q[i], names[i], k) for i, r in zip(which, rows, strict=True)]

    radius = np.zeros(len(q), dtype=np.int64)
    out = found(np.arange(len(q)), rerank)
    for group in np.array_split(np.argsort(radius, kind="stable"), GROUPS):
        sample = group[np.unique(np.linspace(0, len(group) - 1, min(AUDIT, len(group))).astype(int))]
        true = [ranked(x, ids, all_rows, q[i], names[i], k)[1] for i in sample] if rerank < len(x) else []
        least, have = rerank, [out[i] for i in sample]
        while least < len(x) and sum((h[1] <= t[len(t) - 1]).sum() for h, t in zip(have, true, strict=True) if len(t)) < RECALL * sum(map(len, true)):
            least *= 4
            have = found(sample, least)
        if least > rerank:
            for i, f in zip(group, found(group, least), strict=True):
                out[i] = f
    return out


def once(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for each id: of several the one whose vector sorts first."""
    if frame["vec_id"].duplicated().any():
        frame = frame.assign(sort=[tuple(v) for v in frame["embedding"]]).sort_values(["vec_id", "sort"]).drop_duplicates("vec_id")
    return frame.reset_index(drop=True)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, rerank: int = RERANK, shard_rows: int | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of each query, by Euclidean distance in doubles.

    ``queries`` and ``vectors`` have (vec_id, embedding); a row isn't its own neighbour. Vectors that are null, empty,
    zero, of an uncommon dimension or hold null or non-finite components take no part, nor do null ids; of rows
    with one id the vector that sorts first counts. Ties go to the smaller id; with fewer rows than ``k`` all are returned. Every vector is
    indexed in one shard, and every query asks every shard.
    """
    clean = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable("embedding"))
    d = common_dimension(clean)
    clean = clean.where(F.size("embedding") == d)
    asked = queries.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable("embedding")).where(F.size("embedding") == d)
    n, n_asked = clean.count(), asked.count()
    shards, blocks = buckets_for(n, shard_rows or max(1, SHARD_BYTES // (8 * max(d, 1)))), buckets_for(n_asked, query_rows)
    sample = matrix(clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["embedding"], d)
    mean, rotation = learn(sample) if len(sample) else (np.zeros(d), np.zeros((d, SUBSTRING)))
    placed = clean.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        own, ask = once(own), once(ask)
        x, q, ids = matrix(own["embedding"], d), matrix(ask["embedding"], d), own["vec_id"].to_numpy()
        out = []
        if len(own) and len(ask):
            names = ask["vec_id"].tolist()
            for name, (rows, score) in zip(names, neighbours(x, ids, q, names, mean, rotation, k, rerank), strict=True):
                out.append(pd.DataFrame({"query_id": name, "vec_id": ids[rows], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    placed, spread = (f.repartition(shards * blocks, "shard", "block") for f in (placed, spread))  # a group is long work on few bytes
    found = placed.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInPandas(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
