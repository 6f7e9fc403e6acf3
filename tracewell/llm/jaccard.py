"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles. Equal sets are one class. Classes walk down random trees, one tree a
run: a node samples coordinates of min-hash signatures and splits its sets by the token that each coordinate has
sampled from them, so that sets share a branch as often as they are similar. Nodes with few sets stop and compare
all their pairs, first by signature, then by their whole texts; nodes that are still large at the last level are compared in
blocks. A pair counts in the first leaf that it shares. Runs are as many as the target recall asks for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import text as tx
from tracewell.llm.components import connected
from tracewell.llm.hnsw import own_components
from tracewell.llm.store import written

WORDS = 5
THRESHOLD = 0.8
#: Coordinates of a signature; 32 bits are kept of each.
SIGNATURE = 64
#: Pairs whose signatures agree this much less than the threshold asks are not read in full (five standard deviations).
SLACK = 0.25
#: A node with this many sets at most is a leaf.
LEAF = 1_024
DEPTH = 5
#: Chance that one run joins a pair at the threshold, at least (depth 5, one child and another with chance 1/4), and the recall aimed at.
RUN_RECALL, RECALL = 0.33, 0.998
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - RUN_RECALL))

_U = np.uint64
_MULTIPLIERS = tx.mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) | _U(1)
_PLACES = tx.mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | _U(1)


def shingles(buf: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of one document after another, offsets). A shorter text is one shingle of all its words."""
    n = len(off) - 1
    _, _, doc, h = tx.word_hashes(tx.lower_ascii(buf), off)
    many = np.bincount(doc, minlength=n)
    total = max(len(h) - words + 1, 0)
    rolled = np.zeros(total, dtype=np.uint64)
    for k in range(words):
        rolled += h[k : k + total] * _PLACES[k]
    inside = doc[:total] == doc[words - 1 :][:total] if total else np.zeros(0, dtype=bool)
    own, who = tx.mix(rolled[inside]), doc[:total][inside]
    short = np.flatnonzero((many > 0) & (many < words))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(words - 1):
            has = k < many[short]
            extra[has] += h[first[has] + k] * _PLACES[k]
        own, who = np.append(own, tx.mix(extra ^ many[short].astype(np.uint64))), np.append(who, short)
    order = np.lexsort((own, who))
    own, who = own[order], who[order]
    keep = np.ones(len(own), dtype=bool)
    keep[1:] = (own[1:] != own[:-1]) | (who[1:] != who[:-1])
    own, who = own[keep], who[keep]
    return own, np.searchsorted(who, np.arange(n + 1))


def signatures(own: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents x SIGNATURE) of 32 bits: a hash of the token that each coordinate samples; documents without a set have zeros."""
    out = np.zeros((len(off) - 1, SIGNATURE), dtype=np.uint32)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        for k in range(SIGNATURE):
            out[some, k] = (tx.mix(np.minimum.reduceat(own * _MULTIPLIERS[k], off[some])) & _U(0xFFFFFFFF)).astype(np.uint32)
    return out


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, key, signature): the digest of each document's set; null for a text without a word."""

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                own, off = shingles(*tx.texts(part.column("text")))
                sign = signatures(own, off)
                keys = [digest(own[a:b]) if b > a else None for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, type=pa.binary()), pa.array([x.tobytes() for x in sign], type=pa.binary())], names=["doc_id", "key", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, key binary, signature binary")


def children(path: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path of the child): a node samples one coordinate, and a second one with chance 1/4."""
    drawn = tx.mix(path)
    one, two = drawn % _U(SIGNATURE), tx.mix(drawn) % _U(SIGNATURE)
    second = np.flatnonzero((drawn >> _U(62) == 0) & (one != two))
    row = np.concatenate((np.arange(len(path)), second))
    k = np.concatenate((one, two[second])).astype(np.int64)
    value = sign[row, k].astype(np.uint64)
    return row, tx.mix(path[row] ^ tx.mix(value * _U(SIGNATURE) + k.astype(np.uint64) + _U(1)))


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, SIGNATURE)


def roots(classes: DataFrame, runs: int) -> DataFrame:
    start = tx.mix(np.arange(1, runs + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            sign, rep = _signs(batch.column("signature")), batch.column("rep").to_numpy()
            row, path = children(np.tile(start, len(rep)), np.repeat(sign, runs, axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(rep[row // runs]), pa.array(path.view(np.int64))], names=["rep", "path"])

    return classes.select("rep", "signature").mapInArrow(run, "rep bigint, path bigint")


def split(large: DataFrame) -> DataFrame:
    """(rep, path, parent): the sets of large nodes by child, with the size of the node that they come from."""

    def run(batches):
        for batch in batches:
            row, path = children(batch.column("path").to_numpy().view(np.uint64), _signs(batch.column("signature")))
            rep, n = (batch.column(c).to_numpy()[row] for c in ("rep", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(path.view(np.int64)), pa.array(n)], names=["rep", "path", "parent"])

    return large.select("rep", "path", "n", "signature").mapInArrow(run, "rep bigint, path bigint, parent bigint")


def leaves(classes: DataFrame, runs: int = RUNS, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(rep, path, n): the leaves of all runs with two sets at least, and how many sets each has.

    A node is also a leaf, of any size, when half of its parent's sets went its way: they are alike, and further tokens
    would not part them. To stop early only adds pairs.
    """
    found = None
    level = roots(classes, runs).withColumn("parent", F.lit(None).cast("long"))
    for k in range(depth):
        sizes = level.groupBy("path").agg(F.count("*").alias("n"), F.max("parent").alias("parent")).where("n > 1")
        now = written(level.select("rep", "path").join(sizes, "path").select("rep", "path", "n", "parent"), "jaccard-level")
        ends = (F.col("n") <= leaf) | F.coalesce(2 * F.col("n") >= F.col("parent"), F.lit(False))
        done = (now if k == depth - 1 else now.where(ends)).select("rep", "path", "n")
        found = done if found is None else found.union(done)
        large = now.where(~ends)
        if k == depth - 1 or not large.limit(1).count():
            break
        level = split(large.join(classes.select("rep", "signature"), "rep"))
    return found


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of batches sorted by ``keys``, cut only between groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, dtype=bool)
        for key in keys:
            x = batch.column(key).to_numpy()
            changed[1:] |= x[1:] != x[:-1]
            changed[0] |= not held or held[-1].column(key)[-1].as_py() != x[0].item()
        cuts = np.flatnonzero(changed)
        if not len(cuts):
            held.append(batch)
            continue
        if held and cuts[-1]:
            held.append(batch.slice(0, int(cuts[-1])))
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(int(cuts[-1]))]
        elif held:
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch]
        else:
            if cuts[-1]:
                yield pa.Table.from_batches([batch.slice(0, int(cuts[-1]))]).combine_chunks()
            held = [batch.slice(int(cuts[-1]))]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[:1] = True
    for key in keys:
        x = table.column(key).to_numpy()
        changed[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(changed)


GROUP = ("path", "a", "b")


def first_here(path: np.ndarray, known: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a pair's smallest common leaf is the one at hand; ``known`` has each row's leaves, padded with the largest number."""
    out = np.ones(len(i), dtype=bool)
    for low in range(0, len(i), 1 << 14):
        s = slice(low, low + (1 << 14))
        a, b, own = known[i[s]], known[j[s]], path[i[s]]
        for k in range(known.shape[1]):
            earlier = a[:, k] < own
            if earlier.any():
                out[low : low + len(own)] &= ~(earlier & (b == a[:, k, None]).any(axis=1))
    return out


def padded(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of numbers as rows of a matrix, padded with the largest number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy()
    out = np.full((len(sizes), int(sizes.max(initial=1))), np.iinfo(np.int64).max, dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def candidate_rows(placed: DataFrame, threshold: float) -> DataFrame:
    """The rows of leaves that have a partner by signature whose first common leaf this is."""
    least = (threshold - SLACK) * SIGNATURE

    def run(batches):
        for table in whole_groups(batches, GROUP):
            start = group_starts(table, GROUP)
            n = table.num_rows
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
            sign = _signs(table.column("signature"))
            path, block = table.column("path").to_numpy(), table.column("block").to_numpy()
            cross = table.column("a").to_numpy() != table.column("b").to_numpy()
            pairs = []
            for shift in range(1, int(np.diff(np.append(start, n)).max(initial=1))):
                i = np.flatnonzero(group[shift:] == group[:-shift])
                i = i[~cross[i] | (block[i] != block[i + shift])]
                for low in range(0, len(i), 1 << 15):
                    part = i[low : low + (1 << 15)]
                    part = part[(sign[part] == sign[part + shift]).sum(axis=1) >= least]
                    if len(part):
                        pairs.append((part, part + shift))
            if not pairs:
                continue
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            used, at = np.unique(np.concatenate((i, j)), return_inverse=True)
            known = padded(table.column("known").take(pa.array(used)))
            ok = first_here(path[used], known, at[: len(i)], at[len(i) :])
            keep = np.unique(np.concatenate((i[ok], j[ok])))
            yield from table.select(["path", "a", "b", "rep", "key", "size", "block", "known"]).take(pa.array(keep)).to_batches()

    sorted_ = placed.repartition(*GROUP).sortWithinPartitions(*GROUP, "rep")
    return sorted_.mapInArrow(run, "path bigint, a int, b int, rep bigint, key binary, size bigint, block int, known array<bigint>")


def intersections(own: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of all pairs of sets, by matrix products over slices of the shared elements."""
    n = len(own)
    values, at, many = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(x) for x in own])
    shared = many[at] > 1
    place = np.cumsum(many > 1) - 1
    row, col = row[shared], place[at[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), dtype=np.float64)
    wide = max(1, (4 << 20) // max(n, 1))
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        a, b = np.searchsorted(col, (low, low + wide))
        m = np.zeros((n, wide), dtype=np.float32)
        m[row[a:b], col[a:b] - low] = 1
        out += m @ m.T
    return out


def small_intersections(own: list[np.ndarray]) -> np.ndarray:
    """The same for two or three sets, by merging their sorted elements."""
    out = np.zeros((len(own), len(own)))
    for i, j in combinations(range(len(own)), 2):
        both = np.sort(np.concatenate((own[i], own[j])), kind="stable")
        out[i, j] = out[j, i] = (both[1:] == both[:-1]).sum()
    return out


def own_sets(table: pa.Table) -> tuple[list[np.ndarray], list[int]]:
    """The sets of the rows whose text has the row's key, and which rows these are: another text of the same id doesn't count, nor does a repeated one."""
    each, keep, last = [], [], None
    keys, reps, paths, ones, twos = (table.column(c).to_pylist() for c in ("key", "rep", *GROUP))
    at = 0
    for batch in table.to_batches():
        for part in tx.slices(batch, "text"):
            own, off = shingles(*tx.texts(part.column("text")))
            for x, y in zip(off[:-1], off[1:], strict=True):
                now = (paths[at], ones[at], twos[at], reps[at])
                if now != last and digest(own[x:y]) == keys[at]:
                    each.append(own[x:y])
                    keep.append(at)
                    last = now
                at += 1
    return each, keep


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(rep, linked, classes, root) of each leaf's rows: documents and classes linked there, and a linked row that joins its part."""

    def run(batches):
        for table in whole_groups(batches, GROUP):
            each, keep = own_sets(table)
            table = table.take(pa.array(keep))
            start = np.append(group_starts(table, GROUP), table.num_rows)
            rep, size, block, path = (table.column(c).to_numpy() for c in ("rep", "size", "block", "path"))
            cross = table.column("a").to_numpy() != table.column("b").to_numpy()
            known = padded(table.column("known"))
            out = []
            for a, b in zip(start[:-1], start[1:], strict=True):
                common = intersections(each[a:b]) if b - a > 3 else small_intersections(each[a:b])
                sizes = np.array([len(x) for x in each[a:b]])
                link = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
                np.fill_diagonal(link, False)
                if cross[a]:
                    link &= block[a:b, None] != block[None, a:b]
                i, j = np.nonzero(np.triu(link))
                link[:] = False
                ok = first_here(path[a:b], known[a:b], i, j) if len(i) else np.zeros(0, dtype=bool)
                link[i[ok], j[ok]] = link[j[ok], i[ok]] = True
                some = np.flatnonzero(link.any(axis=1))
                if len(some):
                    root = own_components(link)
                    out.append((rep[a:b][some], (link @ size[a:b])[some], link.sum(axis=1)[some], rep[a:b][root[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["rep", "linked", "classes", "root"])

    sorted_ = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "rep")
    return sorted_.mapInArrow(run, "rep bigint, linked bigint, classes bigint, root bigint")


#: Parts into which the rows of one class are dealt when they learn their results; a class may hold a third of all rows.
SALTS = 8


def join(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """One row per document: (doc_id, class_id, n_links, group_id, n_classes).

    ``class_id`` is the smallest id with the same set, ``n_links`` the number of other documents at ``threshold`` or
    more, copies included, ``n_classes`` how many other sets those have, ``group_id`` the smallest id reachable over
    links. A text that is null, empty or without a word has no set and links with nothing; so does a row without
    id, whose class and group are null. Rows with one id are one document, and each is returned; should they have
    several texts, the set with the smallest digest counts. Columns other than doc_id and text are not read.
    """
    named = docs.where("doc_id is not null").select("doc_id", "text")
    known = written(sets(named), "jaccard-sets")
    one = known.groupBy("doc_id").agg(F.min(F.struct("key", "signature")).alias("x")).select("doc_id", "x.*")
    classes = one.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.min("signature").alias("signature"))
    classes = written(classes, "jaccard-classes")
    found = written(leaves(classes, runs, leaf, depth), "jaccard-leaves")
    paths = found.groupBy("rep").agg(F.sort_array(F.collect_set("path")).alias("known"))  # a few for each run
    blocks = F.ceil(F.col("n") / leaf).cast("int")
    spread = found.withColumn("block", F.pmod(F.xxhash64("rep", "path"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("rep", "path", "block", F.greatest("block", "other").alias("a"), F.least("block", "other").alias("b"))
    rows = written(candidate_rows(spread.join(classes.join(paths, "rep"), "rep"), threshold), "jaccard-candidates")
    links = written(verified(rows.join(named.withColumnRenamed("doc_id", "rep"), "rep"), threshold), "jaccard-links")
    counts = links.groupBy("rep").agg(F.sum("linked").alias("linked"), F.sum("classes").alias("classes"))
    groups = connected(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), "jaccard-groups")
    each = classes.select("key", "rep", "size").join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    none = F.lit(0).cast("long")
    each = each.select(
        "key", F.col("rep").alias("class_id"), (F.col("size") - 1 + F.coalesce("linked", none)).alias("n_links"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("classes", none).alias("n_classes")
    ).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = one.where("key is not null").select("doc_id", "key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    result = salted.join(each, ["key", "salt"]).select("doc_id", "class_id", "n_links", "group_id", "n_classes")
    alone = one.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), none.alias("n_links"), F.col("doc_id").alias("group_id"), none.alias("n_classes"))
    nobody = F.lit(None).cast("long")
    nameless = docs.where("doc_id is null").select("doc_id", nobody.alias("class_id"), none.alias("n_links"), nobody.alias("group_id"), none.alias("n_classes"))
    every = known.select("doc_id").join(result.unionByName(alone), "doc_id")  # a row for each row, also of repeated ids
    return every.unionByName(nameless)
