"""Suffix dedup, Jaccard join, nearest neighbours, embedding dedup and language model against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracewell.llm import components, hnsw, jaccard, lm, mih, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_dedup(rows, window=100):
    seen, out = set(), {}
    for doc, text in sorted(set(rows)):
        raw = text.encode()
        covered = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - window + 1):
            part = raw[i : i + window]
            if part in seen:
                covered[i : i + window] = True
            seen.add(part)
        kept = bytes(np.frombuffer(raw, np.uint8)[~covered[:-1]])
        out[doc] = (len(raw), int(covered.sum()), int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcde é\n") for _ in range(n))
    shared = [make(n) for n in (90, 130, 300, 700)]
    rows = []
    for doc in rng.sample(range(1000), 60):
        text = "".join(rng.choice((make(rng.randint(0, 150)), rng.choice(shared), rng.choice(shared)[: rng.randint(50, 600)])) for _ in range(rng.randint(0, 6)))
        rows.append((doc, text))
    return rows + [(2000, "ab" * 400), (2001, "x" * 350), (2002, "ab" * 200), (2003, rows[0][1])]


@pytest.mark.parametrize("part_rows", (1 << 14, 3))
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, part_rows):
    monkeypatch.setattr(suffix_dedup, "PART_ROWS", part_rows)
    rows = passages(part_rows)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert got == brute_dedup(rows)


def test_suffix_dedup_edges(spark, nasty, empty):
    rows = suffix_dedup.dedup(nasty).collect()
    assert len(rows) == nasty.count()
    assert [r["n_removed"] for r in rows if r["doc_id"] in (1, 2, 5, 6)] == [0] * 5
    assert suffix_dedup.dedup(empty).count() == 0
    several = spark.createDataFrame([(1, "a" * 300), (1, "b" * 300), (2, "a" * 300), (2, "a" * 300)], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.dedup(several).collect())
    assert got == [(1, 0), (1, 0), (2, 299), (2, 299)]  # all but the first byte lie in a window that starts later


def test_suffix_dedup_of_a_very_long_text(spark, tmp_path):
    size = 64 << 20
    long = np.random.default_rng(4).integers(33, 127, size).astype(np.uint8)
    long[-1000:] = long[suffix_dedup.BLOCK - 500 : suffix_dedup.BLOCK + 500]  # over the edge of two blocks
    texts = [long.tobytes().decode(), long[40_000_000:40_005_000].tobytes().decode()]
    pq.write_table(pa.table({"doc_id": [1, 2], "text": texts}), tmp_path / "long.parquet")
    rows = {r["doc_id"]: r for r in suffix_dedup.dedup(spark.read.parquet(str(tmp_path / "long.parquet")), keep=False).collect()}
    assert (rows[1]["n_bytes"], rows[1]["n_removed"], rows[1]["n_spans"]) == (size, 1000, 1)
    assert rows[1]["kept_sha256"] == hashlib.sha256(long[:-1000].tobytes()).hexdigest()
    assert (rows[2]["n_removed"], rows[2]["n_spans"]) == (5000, 1)


def test_multikey_sort_orders_strings():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 99, 5000).astype(np.uint8)
    start = rng.integers(0, 4800, 600)
    order, segment = suffix_dedup.multikey_sort(buf, start, np.zeros(600, np.int64), 100)
    strings = [buf[s : s + 100].tobytes() for s in start[order]]
    assert strings == sorted(strings)
    assert [a == b for a, b in zip(strings[1:], strings[:-1], strict=True)] == (segment[1:] == segment[:-1]).tolist()


def brute_jaccard(rows, threshold=0.8):
    sets = {}
    for doc, text in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
        if w:
            sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    links, parent = collections.Counter(), {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (links[d], find(d)) for d, _ in rows}


@pytest.mark.parametrize(("leaf", "depth"), ((1024, 5), (4, 3)))
def test_jaccard_join_equals_brute_force(spark, leaf, depth):
    rng = random.Random(leaf)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows, doc = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice((1, 2, 3, 12))):
            now = list(base)
            for _ in range(rng.randint(0, 3)):
                now[rng.randrange(len(now))] = word()
            rows.append((doc, " ".join(now)))
            doc += 1
    runs = jaccard.RUNS if leaf > 4 else 40
    got = {r["doc_id"]: (r["n_links"], r["group_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), leaf=leaf, depth=depth, runs=runs).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_edges(nasty, empty):
    rows = jaccard.join(nasty).collect()
    assert len(rows) == nasty.count()
    by = {r["doc_id"]: r for r in rows}
    assert (by[5]["n_links"], by[6]["class_id"], by[6]["group_id"]) == (1, 5, 5)
    assert by[2]["n_links"] == 0 and by[1]["group_id"] == 1 and by[None]["group_id"] is None
    assert jaccard.join(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1)]
    rows += [(8, [1.0, 0.01], None), (9, [], 2), (10, [1.0, 2.0, 3.0], 1), (None, [1.0, 0.0], 1), (11, [float("inf"), 0.0], 1), (12, [2.0, 0.0], 1)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<float>, label int, rep string, size string")


def test_embedding_dedup_edges(spark):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_duplicates(odd_vectors(spark)).collect()}
    assert got[1] == (2, 1, True) and got[12] == (2, 1, False) and got[3] == (0, 3, True)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11)) and len(got) == 13
    assert hnsw.near_duplicates(odd_vectors(spark).limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", (8192, 60))
def test_embedding_dedup_equals_brute_force(vectors, shard_rows):
    rows = vectors.collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(vectors, shard_rows=shard_rows).collect()}
    found = sum(got[r["vec_id"]]["n_links"] for r in rows)
    assert all(got[r["vec_id"]]["n_links"] <= n for r, n in zip(rows, link.sum(axis=1), strict=True)) and found >= 0.99 * link.sum()
    root = {rows[i]["vec_id"]: rows[j]["vec_id"] for i, j in enumerate(hnsw.own_components(link))}
    assert sum(got[k]["component_id"] == v for k, v in root.items()) >= 0.99 * len(root)


@pytest.mark.parametrize("across", (False, True))
def test_sparse_links_are_found(across):
    """Thirty pairs in a broad cluster of 4,000 rows."""
    rng = np.random.default_rng(5)

    def unit(*size):
        x = rng.normal(size=size)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    centre, around = unit(1, 256), unit(4000, 256)
    x = centre + 0.6 * around
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:60:2] = x[1:60:2] + 0.3 * unit(30, 256)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(4000)]
    a, b = (x[:2000], x[2000:]) if across else (x, x)
    true, got = b @ a.T >= 0.93, hnsw.linked(a, b, 0.93)
    if not across:
        np.fill_diagonal(true, False)
        np.fill_diagonal(got, False)
    assert true.any() and not (got & ~true).any() and (got & true).sum() >= 0.99 * true.sum()


def test_graph_search_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:200] + rng.normal(scale=0.05, size=(200, 32)).astype(np.float32)
    rows, _ = hnsw.Hnsw(x).query(q, 64)
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(rows, true, strict=True)]) >= 0.9


def test_nearest_neighbours_recall(vectors):
    found = collections.defaultdict(list)
    for r in mih.search(vectors, vectors.where("vec_id % 10 = 0"), rerank=60, shard_rows=150).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r)
    rows = vectors.collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=float), np.array([r["vec_id"] for r in rows])
    hit = total = 0
    for q in ids[ids % 10 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & {r["vec_id"] for r in found[q]})
        total += 10
        assert [r["score"] for r in found[q]] == sorted(r["score"] for r in found[q])
        assert all(abs(r["score"] - d[ids == r["vec_id"]][0]) < 1e-9 for r in found[q])
    assert hit >= 0.9 * total


def test_nearest_neighbours_in_a_dense_group():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=(6_667, 64))
    x[:6_667] = x[0] + 0.3 * off / np.linalg.norm(off, axis=1, keepdims=True)
    ids = np.arange(len(x))
    names = [*range(100, 200), *range(10_000, 10_100)]
    mean, rotation = mih.learn(x[::5])
    got = mih.neighbours(x, ids, x[names], names, mean, rotation, 10, mih.RERANK)
    true = [mih.ranked(x, ids, ids, x[n], n, 10)[0] for n in names]
    hit = [len(set(a) & set(b)) / 10 for (a, _), b in zip(got, true, strict=True)]
    assert np.mean(hit[:100]) >= 0.9 and np.mean(hit[100:]) >= 0.9


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(0)
    code = rng.integers(0, 1 << 16, (2000, 8)).astype(np.uint16)
    code[1000:] = code[:1000] ^ (1 << rng.integers(0, 16, (1000, 8))).astype(np.uint16) * (rng.random((1000, 8)) < 0.3)
    index = mih.Index(code)
    queries = code[::20]
    for least in (2, 50):
        for q, rows in zip(queries, index.nearest(queries, least), strict=True):
            d = np.bitwise_count(code ^ q).sum(axis=1)
            assert set(rows) == set(np.flatnonzero(d <= np.sort(d)[least - 1]))


def test_probing_touches_few_of_many_rows():
    """Groups of 50 near one another among 200,000 vectors."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(4_000, 64)), 50, axis=0) + 0.25 * rng.normal(size=(200_000, 64))
    mean, rotation = mih.learn(x[:: len(x) // 4096][:4096])
    code = mih.codes(x, mean, rotation)
    index = mih.Index(code)
    asked = np.arange(0, len(x), 1000)
    hit = 0
    for i, rows in zip(asked, index.nearest(code[asked], 41), strict=True):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        own = rows[rows != i]
        hit += len(set(np.argsort(d)[:10]) & set(own[np.argsort(d[own])[:10]]))
    assert hit >= 0.95 * 10 * len(asked)
    assert index.touched < 0.2 * len(x) * len(asked)


def test_nearest_neighbour_edges(spark):
    v = odd_vectors(spark)
    got = [(r["query_id"], r["vec_id"]) for r in mih.search(v, v).orderBy("query_id", "rank").collect()]
    assert {q for q, _ in got} == {1, 2, 3, 8, 12} and len(got) == 20
    assert [x for q, x in got if q == 1] == [2, 8, 12, 3]
    assert mih.search(v.limit(0), v).count() == 0


def test_language_model_counts_and_gain(documents):
    rows = lm.score(documents).collect()
    tokens = {r["doc_id"]: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")), None] for r in documents.collect()}
    train = {d: t for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 10}
    count = collections.Counter(x for t in train.values() for x in t)
    n, v = sum(count.values()), len(count)
    for r in rows:
        t = tokens[r["doc_id"]]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(count[x] > 0 for x in t), n)
        assert abs(base - r["base_score"]) < 1e-6 * max(1, abs(base)) and r["held_out"] == (r["doc_id"] not in train)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)


def small_model(words=40):
    rng = np.random.default_rng(2)
    hashes = rng.integers(1, 1 << 63, words).astype(np.uint64)
    order = np.argsort(hashes)
    stats = lm.Corpus(5000, 200, hashes[order], order, np.arange(words, 0, -1) * 10, np.array([0, 3, 12, words]), np.arange(1, lm.FORMS + 1) * 7, np.ones(lm.FORMS, dtype=np.int64))
    model = lm.fresh(stats)
    for x in model.parts():
        x += rng.normal(scale=0.5, size=x.shape).astype(np.float32)
    return stats, model


def plain_log_prob(stats, model, units, ends):
    """The model token by token, as it is written down."""
    out, first = [], 0
    for end in ends:
        doc = units[first:end]
        for t, u in enumerate(doc):
            begin = t - t % lm.HISTORY
            r = lambda k: model.r[doc[k]] if k >= begin else model.r[-1]  # noqa: E731, B023
            p = r(t - 1) * model.maps[0] + r(t - 2) * model.maps[1]
            if t > begin:
                p = p + np.mean([model.r[x] for x in doc[begin:t]], axis=0) * model.maps[2]
            s = np.array([p @ q + b for q, b in zip(model.c, model.cb, strict=True)])
            kind = next((k for k in range(len(stats.begin) - 1) if stats.begin[k] <= u < stats.begin[k + 1]), u - stats.words + len(stats.begin) - 1)
            value = s[kind] - np.log(np.exp(s).sum())
            if u < stats.words:
                s = {m: p @ model.w[m] + model.wb[m] for m in range(stats.begin[kind], stats.begin[kind + 1])}
                value += s[u] - np.log(sum(np.exp(x) for x in s.values()))
            out.append(value)
        first = end
    return np.array(out)


def test_language_model_equals_its_plain_double(monkeypatch):
    monkeypatch.setattr(lm, "HISTORY", 7)
    stats, model = small_model()
    units = np.random.default_rng(3).integers(0, stats.words + lm.FORMS, 60)
    ends = np.array([1, 2, 25, 60])
    assert np.allclose(model.log_prob(units, ends, stats), plain_log_prob(stats, model, units, ends), atol=1e-4)


def test_language_model_is_normalised():
    stats, model = small_model()
    every = np.arange(stats.words + lm.FORMS)
    total = 0.0
    for u in every:
        total += np.exp(model.log_prob(np.array([3, 50, u]), np.array([3]), stats)[2])
    assert abs(total - 1) < 1e-4
    # within a form: known tokens and one unknown
    counts = np.array([4, 9, 1])
    mass = counts.sum() + lm.SMOOTH * (len(counts) + 1)
    assert abs(((counts + lm.SMOOTH) / mass).sum() + lm.SMOOTH / mass - 1) < 1e-12


def test_training_gradient_raises_the_likelihood():
    stats, _ = small_model()
    rng = np.random.default_rng(6)
    units = np.tile(rng.integers(0, stats.words + lm.FORMS, 50), 200)
    ends = np.arange(50, 10_001, 50)
    model = lm.fresh(stats)
    new = model
    for k in range(4):
        new = lm.nce(new, stats, units, ends, 0.3, k)
    assert new.log_prob(units, ends, stats).mean() > model.log_prob(units, ends, stats).mean() + 1.5


def test_language_model_does_not_depend_on_the_layout(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 100_000)
    found = [{r["doc_id"]: r["score"] for r in lm.score(documents.repartition(n)).collect()} for n in (1, 4, 16)]
    assert len(found[0]) > 100
    for other in found[1:]:
        assert all(abs(other[k] - x) <= 1e-6 * abs(x) for k, x in found[0].items())


def test_language_model_edges(nasty, empty):
    rows = lm.score(nasty).collect()
    assert len(rows) == nasty.count() and sum(r["doc_id"] is None for r in rows) == 2
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == 1 and by[2]["n_tokens"] == 1 and by[4]["n_tokens"] == 2
    assert lm.score(empty).count() == 0
