"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard, verified links, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import connected
from tracewell.llm.store import written
from tracewell.llm.vectors import common_dimension, matrix, usable

#: Links of a node at upper levels; twice as many at the ground level.
DEGREE = 16
#: Beam while building, and first beam of a search.
BEAM = 64
#: Vectors of one shard at most, about.
SHARD_ROWS = 8_192
#: Rows searched at a time.
BATCH = 1_024
#: Audited rows with links of a task, and the share of their true links that a search must find.
AUDIT, RECALL = 128, 0.99


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(rows, similarities), best first, -1 beyond what was reached: beam search of all queries in step.

    ``graph`` has a node's links in its row, -1 for none; ``entry`` has a first row for each query.
    """
    n, total = len(queries), len(x)
    seen = np.zeros((n, total + 1), dtype=bool)
    seen[:, total] = True
    rows = np.full((n, beam), -1, dtype=np.int64)
    sims = np.full((n, beam), -np.inf, dtype=np.float32)
    fresh = np.zeros((n, beam), dtype=bool)
    rows[:, 0], fresh[:, 0] = entry, True
    sims[:, 0] = np.einsum("ij,ij->i", queries, x[entry])
    seen[np.arange(n), entry] = True
    active = np.arange(n)
    while len(active):
        order = np.argsort(np.where(fresh[active], -sims[active], np.inf), axis=1, kind="stable")[:, :expand]
        take = np.take_along_axis(fresh[active], order, 1)
        found = graph[np.where(take, np.take_along_axis(rows[active], order, 1), 0)]
        found = np.where(take[:, :, None], found, -1).reshape(len(active), -1)
        fresh[active[:, None], order] = False
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        new = ~seen[active[:, None], found] & (found >= 0)
        seen[active[:, None], found] = True
        near = np.where(new, np.einsum("ij,ikj->ik", queries[active], x[found]), -np.inf).astype(np.float32)
        all_sims = np.concatenate((sims[active], near), axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(all_sims, best, 1)
        rows[active] = np.take_along_axis(np.concatenate((rows[active], np.where(new, found, -1)), axis=1), best, 1)
        fresh[active] = np.take_along_axis(np.concatenate((fresh[active], new), axis=1), best, 1)
        active = active[fresh[active].any(axis=1)]
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(rows, order, 1), np.take_along_axis(sims, order, 1)


def diverse(x: np.ndarray, own: np.ndarray, rows: np.ndarray, degree: int) -> np.ndarray:
    """Of each node's candidates, best first, those nearer to the node than to a candidate already kept; then the best others."""
    if rows.shape[1] < degree:
        rows = np.pad(rows, ((0, 0), (0, degree - rows.shape[1])), constant_values=-1)
    valid = rows >= 0
    v = x[rows]
    to_own = np.where(valid, np.einsum("ij,ikj->ik", x[own], v), -np.inf)
    order = np.argsort(-to_own, axis=1, kind="stable")
    rows, to_own, valid = (np.take_along_axis(a, order, 1) for a in (rows, to_own, valid))
    v = np.take_along_axis(v, order[:, :, None], 1)
    between = v @ v.transpose(0, 2, 1)
    kept = np.zeros(rows.shape, dtype=bool)
    for k in range(rows.shape[1]):
        rival = np.where(kept[:, :k], between[:, k, :k], -np.inf).max(axis=1, initial=-np.inf)
        kept[:, k] = valid[:, k] & (to_own[:, k] > rival) & (kept.sum(axis=1) < degree)
    first = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :degree]
    return np.where(np.take_along_axis(valid, first, 1), np.take_along_axis(rows, first, 1), -1)


def level_graph(x: np.ndarray, members: np.ndarray, degree: int, beam: int = BEAM) -> np.ndarray:
    """The graph of one level over all rows of ``x``: members join in growing batches, each linked to what is there."""
    graph = np.full((len(x), degree), -1, dtype=np.int64)
    done = 0
    while done < len(members):
        batch = members[done : done + max(256, min(done, BATCH))]
        inner = x[batch] @ x[batch].T
        np.fill_diagonal(inner, -np.inf)
        k = min(beam // 2, len(batch))
        near = batch[np.argpartition(-inner, k - 1, axis=1)[:, :k]] if len(batch) > 1 else np.full((1, 1), -1)
        if done:
            near = np.concatenate((search(x, graph, x[batch], np.full(len(batch), members[0]), beam)[0], near), axis=1)
        near = np.where(near == batch[:, None], -1, near)
        links = diverse(x, batch, near, degree)
        graph[batch] = links
        source, target = np.repeat(batch, degree), links.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, many = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(nodes), BATCH):
            part = slice(low, low + BATCH)
            wide = min(int(many[part].max(initial=1)), 4 * degree)
            place = start[part, None] + np.arange(wide)
            back = np.where(np.arange(wide) < many[part, None], source[np.minimum(place, len(source) - 1)], -1)
            both = np.sort(np.concatenate((graph[nodes[part]], back), axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            graph[nodes[part]] = diverse(x, nodes[part], both, degree)
        done += len(batch)
    return graph


class Hnsw:
    """Levels drawn from a hash-like sequence of the row numbers; searches walk down to the ground level."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE):
        self.x = x
        level = np.floor(-np.log(np.random.default_rng(11).random(len(x))) / np.log(degree)).astype(int)
        self.levels = []
        for k in range(int(level.max(initial=0)), -1, -1):
            members = np.flatnonzero(level >= k)
            self.levels.append((members[0], level_graph(x, members, degree if k else 2 * degree)))

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full(len(q), self.levels[0][0])
        for _, graph in self.levels[:-1]:
            entry = search(self.x, graph, q, entry, 8)[0][:, 0]
        return search(self.x, self.levels[-1][1], q, entry, beam)


def audited(x: np.ndarray, q: np.ndarray, threshold: float, audit: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(queries, their links to other rows) of ``audit`` queries or more that have links, in a fixed random order; None if a quarter of the queries hold fewer."""
    order = np.random.default_rng(13).permutation(len(q))[: max(audit, len(q) // 4)]
    queries, links = [], []
    for low in range(0, len(order), audit):
        part = order[low : low + audit]
        link = q[part] @ x.T >= threshold
        if q is x:
            link[np.arange(len(part)), part] = False
        some = link.any(axis=1)
        queries.append(part[some])
        links.append(link[some])
        if sum(map(len, queries)) >= audit:
            return np.concatenate(queries), np.concatenate(links)
    return None


def linked(x: np.ndarray, q: np.ndarray, threshold: float, audit: int = AUDIT, recall: float = RECALL, beam: int = BEAM) -> np.ndarray:
    """(queries x rows) of booleans: the links found, none of them below ``threshold`` in doubles. Rows have length 1.

    A query whose whole beam lies above the threshold is asked again with a wider beam. An audit compares
    queries with all rows until enough with links to other rows were seen, and widens every beam until these find their
    links; where links are too sparse for that, all queries are compared with all rows. A beam that would see as many rows as there are, and
    any of a quarter of the rows, gives way to a comparison with all of them.
    """
    out = np.zeros((len(q), len(x)), dtype=bool)
    if not len(x) or not len(q):
        return out
    narrow, wide = x.astype(np.float32), q.astype(np.float32)
    edge = threshold - 1e-4
    truth = audited(x, q, threshold, audit) if 4 * beam < len(x) else None
    graph = Hnsw(narrow) if truth else None
    while True:
        open_ = np.arange(len(q))
        out[:] = False
        now = beam
        while len(open_):
            again = []
            for low in range(0, len(open_), BATCH):
                part = open_[low : low + BATCH]
                if graph is None or 4 * now >= len(x) or (now > beam and 2 * DEGREE * now >= len(x)):
                    out[part] = wide[part] @ narrow.T >= edge
                    continue
                rows, sims = graph.query(wide[part], now)
                i, j = np.nonzero((sims >= edge) & (rows >= 0))
                out[part[i], rows[i, j]] = True
                again.append(part[(sims[:, -1] >= edge) & (rows[:, -1] >= 0)])
            open_ = np.concatenate(again) if again else open_[:0]
            now *= 4
        for low in range(0, len(q), BATCH):
            i, j = np.nonzero(out[low : low + BATCH])
            for a in range(0, len(i), 1 << 17):
                s = slice(a, a + (1 << 17))
                out[low + i[s], j[s]] = np.einsum("ij,ij->i", q[low + i[s]], x[j[s]]) >= threshold
        if graph is None or 4 * beam >= len(x):
            return out
        true, hit = truth[1].sum(axis=1), (out[truth[0]] & truth[1]).sum(axis=1)
        if hit.sum() >= recall * true.sum() and (hit / true).mean() >= recall:
            return out
        beam *= 2


def weighed(link: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of ``size`` over the links of each row, some rows at a time: the product turns booleans into long numbers."""
    return np.concatenate([link[low : low + BATCH] @ size for low in range(0, len(link), BATCH)] or [np.zeros(0, dtype=np.int64)])


def own_components(link: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric matrix."""
    label = np.arange(len(link))
    seen = np.zeros(len(link), dtype=bool)
    for root in range(len(link)):
        if not seen[root]:
            edge = np.array([root])
            seen[root] = True
            while len(edge):
                label[edge] = root
                edge = np.flatnonzero(link[edge].any(axis=0) & ~seen)
                seen[edge] = True
    return label


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links join rows of one label at cosine ``threshold`` or more.

    Equal vectors of a label are searched once and counted each. Vectors that are null, empty, zero, of an uncommon
    dimension or hold null or non-finite components, and rows without id or label, link with nothing and are a
    component of their own. Rows with one id count as different vectors.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding")
    d = common_dimension(rows.where(good))
    good = F.coalesce(good & (F.size("embedding") == d), F.lit(False))
    classes = written(rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "hnsw-classes")
    shards = classes.groupBy("label").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"), F.count("*").alias("n"))
    # a task for some pairs of shards, by their work and not by their bytes: as many as there are pairs, or as blocks of 1,024 rows in them
    groups, blocks = shards.agg(F.coalesce(F.sum(F.col("shards") * (F.col("shards") + 1) / 2), F.lit(0)).cast("long"), F.coalesce(F.sum(F.col("n") * F.col("shards")), F.lit(0))).first()
    tasks = max(1, min(groups, max(-(-blocks // BATCH), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    shards = shards.drop("n")
    placed = classes.join(shards, "label").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    numbers = F.sequence(F.lit(0), F.col("shards") - 1)
    # a task for each pair of shards (a >= b) of a label: a has the graph, b asks
    pairs = placed.select("label", "rep", "size", "embedding", "shard", F.explode(numbers).alias("other")).select(
        "label", "rep", "size", "embedding", "shard", F.greatest("shard", "other").alias("a"), F.least("shard", "other").alias("b")
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", ignore_index=True)
        x = matrix(part["embedding"], d)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rep, size = part["rep"].to_numpy(), part["size"].to_numpy()
        a, b = part["a"].iat[0], part["b"].iat[0]
        if a == b:
            link = linked(x, x, threshold)
            link |= link.T
            np.fill_diagonal(link, False)
            count, root = weighed(link, size), own_components(link)
        else:
            is_a = (part["shard"] == a).to_numpy()
            ia, ib = np.flatnonzero(is_a), np.flatnonzero(~is_a)
            cross = linked(x[ia], x[ib], threshold)
            count = np.zeros(len(part), dtype=np.int64)
            count[ia], count[ib] = weighed(cross.T, size[ib]), weighed(cross, size[ia])
            root = two_sided(cross, ia, ib, len(part))
        some = count > 0
        return pd.DataFrame({"rep": rep[some], "linked": count[some], "root": rep[root[some]]})

    found = written(pairs.repartition(tasks, "label", "a", "b").groupBy("label", "a", "b").applyInPandas(run, "rep bigint, linked bigint, root bigint"), "hnsw-links")
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    parts = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "hnsw-components")
    known = classes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    joined = rows.where(good).join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def two_sided(cross: np.ndarray, ia: np.ndarray, ib: np.ndarray, n: int) -> np.ndarray:
    """Smallest row reachable from each of ``n`` rows over the links between the rows ``ib`` and ``ia``."""
    label = np.arange(n)
    while True:
        low = label.copy()
        for side, (own, other) in enumerate(((ib, ia), (ia, ib))):
            link = cross if side == 0 else cross.T
            for k in np.flatnonzero(link.any(axis=1)):
                low[own[k]] = min(low[own[k]], low[other[link[k]]].min())
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low
