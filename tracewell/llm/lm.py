"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation, and exact corpus counts.

Documents are dealt into chunks by a hash of what they are, so that neither counts nor the model depend on how the
input is laid out; chunks keep their token numbers in a written table. Counts come from all training documents: every
chunk sends its distinct tokens, by hash range, to where they are added up, and gets the totals back.

Frequent tokens, the more the larger the corpus, have vectors of their own. The vector predicted for a token comes
from the two tokens before it and the mean of those before in its document. It gives the token's class first: classes
of frequent tokens of like frequency, and forms (length and ending) of all others. Within a class of frequent tokens
it then gives the token, within a form corpus counts do. Both steps are normalised by batched matrix products, so the
probabilities of all tokens, with one unknown of each form, add up to 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import text as tx
from tracewell.llm.store import buckets_for, delete_written, written

#: Tokens with vectors of their own: at most this many times the root of the number of training tokens, and no more than OWN_MOST (50 MB of vectors).
OWN_RATE, OWN_MOST = 2.0, 1 << 18
#: A token with a vector of its own occurs so often, at least.
OWN_COUNT = 5
#: Classes of other tokens: by length and ending.
FORMS = 32
DIM = 16
#: Noise for a true class (in expectation) and for a true token of a class (drawn).
NOISE, DRAWN = 16, 2
#: Rounds of training; every chunk trains on another part of its documents in each, and their mean begins the next.
ROUNDS = 2
RATE = 0.3
SMOOTH = 0.1
#: Bytes of text in a chunk, about, and chunks of a task.
CHUNK_BYTES, CHUNKS_PER_TASK = 4 << 20, 16
#: Bytes of a chunk that are split into words at once: temporary arrays take some 60 bytes a byte.
PIECE_BYTES = 1 << 19
#: Tokens whose mean is the history of the next one, at most, and tokens of a step of training, about.
HISTORY, BATCH = 4_096, 4_096
#: Distinct tokens of chunks that one task adds up, about.
BUCKET_TOKENS = 400_000
#: Hash of the token that ends every document; it is no word's.
END = np.uint64(0)


def form(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A class from 0 to FORMS-1 by length and the last two bytes."""
    tail = buf[end - 1].astype(np.uint64) * np.uint64(256) + np.where(end - start > 1, buf[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    return ((tx.mix(tail) % np.uint64(FORMS // 2)).astype(np.int64) * 2 + (end - start > 6)).astype(np.int64)


def hashed(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, form) of every word, worked on in pieces that end at white space."""
    out, low = [], 0
    while low < len(buf):
        high = min(len(buf), low + PIECE_BYTES)
        while high < len(buf) and not tx.SPACE[buf[high]] and high not in off:
            gap = np.flatnonzero(tx.SPACE[buf[high : high + 65_536]])
            high = high + int(gap[0]) if len(gap) else min(len(buf), high + 65_536)
        piece = buf[low:high]
        start, end, doc, h = tx.word_hashes(piece, np.clip(off, low, high) - low)
        out.append((doc, h, form(piece, start, end)))
        low = high
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


CHUNK = "chunk string, number bigint, doc_ids binary, has_id binary, held binary, ends binary, tokens binary, hashes binary, forms binary, counts binary, n_distinct bigint, n_train bigint"


def dealt(batches):
    """(block, number within it, rows) of chunks: rows sorted by block, cut where CHUNK_BYTES are full, wherever batches end."""
    held, block, number, size = [], None, 0, 0
    for batch in batches:
        begin = 0
        blocks = batch.column("block").to_pylist()
        for k, (b, n) in enumerate(zip(blocks, np.diff(tx.offsets(batch.column("text"))).tolist(), strict=True)):
            if b != block or (size and size + n > 2 * CHUNK_BYTES):
                held.append(batch.slice(begin, k - begin))
                if block is not None and size >= 0:
                    yield block, number, held
                held, begin, size = [], k, 0
                number = number + 1 if b == block else 0
                block = b
            size += n
        held.append(batch.slice(begin))
    if block is not None:
        yield block, number, held


def chunks(docs: DataFrame, folds: int, held_out_fold: int) -> DataFrame:
    """One row per chunk: distinct token hashes with forms and training counts, and the tokens as numbers of these."""

    def run(batches):
        for block, number, held in dealt(batches):
            part = pa.Table.from_batches([x for x in held if x.num_rows]).combine_chunks()
            buf, off = tx.texts(part.column("text").combine_chunks())
            doc, h, kinds = hashed(tx.lower_ascii(buf), off)
            n = part.num_rows
            out = part.column("held").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
            hashes, first, at = np.unique(np.maximum(h, 1), return_index=True, return_inverse=True)
            hashes = np.append(END, hashes)  # the end token stands first
            kinds = np.append(0, kinds[first])
            many = np.bincount(doc, minlength=n)
            ends = np.cumsum(many + 1)
            tokens = np.zeros(int(ends[-1]), dtype=np.uint32)
            tokens[np.arange(len(at)) + doc] = at + 1
            train = np.repeat(~out, many + 1)
            ids = part.column("doc_id").combine_chunks()
            row = {
                "chunk": f"{block}-{number}",
                "number": block * 1_000_003 + number,
                "doc_ids": ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                "has_id": ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
                "held": out.tobytes(),
                "ends": ends.astype("<i8").tobytes(),
                "tokens": tokens.tobytes(),
                "hashes": hashes.tobytes(),
                "forms": kinds.astype(np.uint8).tobytes(),
                "counts": np.bincount(tokens[train], minlength=len(hashes)).astype("<u4").tobytes(),
                "n_distinct": len(hashes),
                "n_train": int(train.sum()),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_CHUNK)

    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(tx.fold("doc_id", folds) == held_out_fold, F.lit(False)).alias("held"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = buckets_for(size, CHUNK_BYTES)
    keyed = known.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("block", F.pmod("key", F.lit(blocks)))
    return spread(keyed, blocks, "block", CHUNKS_PER_TASK).sortWithinPartitions("block", "key", "doc_id").drop("key").mapInArrow(run, CHUNK)


_CHUNK = pa.schema([("chunk", pa.string()), ("number", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "has_id", "held", "ends", "tokens", "hashes", "forms", "counts")), ("n_distinct", pa.int64()), ("n_train", pa.int64())])


def added_up(table: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, total binary): for each chunk's distinct tokens of a hash range, their counts in all training documents.

    A row with a null chunk has the range's distinct tokens with counts above zero, for statistics.
    """

    def send(batches):
        for batch in batches:
            for chunk, hashes, forms, counts in each_row(batch, "chunk", "hashes", "forms", "counts"):
                h, f, c = np.frombuffer(hashes, np.uint64), np.frombuffer(forms, np.uint8), np.frombuffer(counts, "<u4")
                owner = bucket_of(h, buckets)
                cut = np.searchsorted(owner, np.arange(buckets + 1))  # hashes rise, so do their buckets
                for b in np.flatnonzero(cut[1:] > cut[:-1]):
                    s = slice(cut[b], cut[b + 1])
                    yield pa.RecordBatch.from_pylist([{"bucket": int(b), "chunk": chunk, "hashes": h[s].tobytes(), "forms": f[s].tobytes(), "counts": c[s].tobytes()}], schema=sent)

    sent = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("hashes", pa.binary()), ("forms", pa.binary()), ("counts", pa.binary())])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in part["hashes"]])
        c = np.concatenate([np.frombuffer(x, "<u4") for x in part["counts"]])
        f = np.concatenate([np.frombuffer(x, np.uint8) for x in part["forms"]])
        known, first, at = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(at, weights=c, minlength=len(known)).astype("<i8")
        sizes = [len(x) // 8 for x in part["hashes"]]
        back = np.split(total[at], np.cumsum(sizes)[:-1])
        seen = total > 0
        own = {"chunk": [*part["chunk"], None], "total": [*(x.tobytes() for x in back), total[seen].tobytes()]}
        own |= {"hashes": [None] * len(part) + [known[seen].tobytes()], "forms": [None] * len(part) + [f[first][seen].tobytes()]}
        return pd.DataFrame({"bucket": part["bucket"].iat[0], **own})

    asked = table.select("chunk", "hashes", "forms", "counts").mapInArrow(send, "bucket int, chunk string, hashes binary, forms binary, counts binary")
    return spread(asked, buckets, "bucket").groupBy("bucket").applyInPandas(add, "bucket int, chunk string, total binary, hashes binary, forms binary")


def spread(df: DataFrame, groups: int, key: str, each: int = 4) -> DataFrame:
    """Rows dealt by ``key`` over as many partitions as hold ``each`` groups, so that partitions don't grow with the data."""
    return df.repartition(max(-(-groups // each), min(groups, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))), key)


def each_row(batch: pa.RecordBatch, *names: str):
    """Values of a batch row by row; binary ones as views of the batch, so that no second copy of it is made."""
    columns = [batch.column(c) for c in names]
    for k in range(batch.num_rows):
        yield tuple(c[k].as_buffer() if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c[k].as_py() for c in columns)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def level(total: np.ndarray) -> np.ndarray:
    """Counts on a scale of 16 steps for each doubling, from 0 to 1023."""
    return np.minimum(np.floor(16 * np.log2(np.maximum(total, 1))), 1023).astype(np.int64)


def statistics(totals: DataFrame) -> DataFrame:
    """For each hash range: N, V, tokens and kinds of the forms, and how many tokens there are of each level."""

    def run(batches):
        for batch in batches:
            for total, forms in zip(*(batch.column(c).to_pylist() for c in ("total", "forms")), strict=True):
                t, f = np.frombuffer(total, "<i8"), np.frombuffer(forms, np.uint8)
                yield pa.RecordBatch.from_pylist(
                    [{
                        "n": int(t.sum()), "v": len(t), "levels": np.bincount(level(t), minlength=1024).tolist(),
                        "form_n": np.bincount(f, weights=t, minlength=FORMS).astype(np.int64).tolist(), "form_v": np.bincount(f, minlength=FORMS).astype(np.int64).tolist(),
                    }],
                    schema=pa.schema([("n", pa.int64()), ("v", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("levels", "form_n", "form_v"))]),
                )

    return totals.where("chunk is null").mapInArrow(run, "n bigint, v bigint, levels array<bigint>, form_n array<bigint>, form_v array<bigint>")


def frequent(totals: DataFrame, least: int) -> DataFrame:
    """(hash, n, form) of the training tokens of a level or higher ones."""

    def run(batches):
        for batch in batches:
            for total, hashes, forms in zip(*(batch.column(c).to_pylist() for c in ("total", "hashes", "forms")), strict=True):
                t, h, f = np.frombuffer(total, "<i8"), np.frombuffer(hashes, np.int64), np.frombuffer(forms, np.uint8)
                own = (level(t) >= least) & (t >= OWN_COUNT)
                yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(t[own]), pa.array(f[own].astype(np.int32))], names=["hash", "n", "form"])

    return totals.where("chunk is null").mapInArrow(run, "hash bigint, n bigint, form int")


@dataclass
class Corpus:
    """Training tokens N, distinct ones V, and the model's units.

    Units are the tokens with vectors of their own, from the most frequent on, then the forms, then the mark that stands
    before a document. ``own`` are the sorted hashes of the former, ``unit`` their units, ``unit_n`` their counts by unit,
    ``begin`` the first unit of each of their classes and the end of the last; ``form_n`` and ``form_v`` are tokens and
    kinds of the forms without them.
    """

    n: int
    v: int
    own: np.ndarray
    unit: np.ndarray
    unit_n: np.ndarray
    begin: np.ndarray
    form_n: np.ndarray
    form_v: np.ndarray

    @property
    def words(self) -> int:
        return len(self.own)

    @property
    def classes(self) -> int:
        return len(self.begin) - 1 + FORMS

    def class_n(self) -> np.ndarray:
        """Tokens of every class: those of frequent tokens, then the forms."""
        return np.concatenate((np.add.reduceat(self.unit_n, self.begin[:-1]) if self.words else np.zeros(0), self.form_n)).astype(float)

    def class_of(self, units: np.ndarray) -> np.ndarray:
        return np.where(units < self.words, np.searchsorted(self.begin, units, side="right") - 1, units - self.words + len(self.begin) - 1)

    def units_of(self, hashes: np.ndarray, forms: np.ndarray) -> np.ndarray:
        if not self.words:
            return forms.astype(np.int64)
        at = np.minimum(np.searchsorted(self.own, hashes), self.words - 1)
        return np.where(self.own[at] == hashes, self.unit[at], forms.astype(np.int64) + self.words)


def corpus(totals: DataFrame) -> Corpus:
    """Sums over the hash ranges; only sums and the frequent tokens, of a bounded number, come to the driver."""
    each = written(statistics(totals), "lm-statistics")
    n, v = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    summed = lambda c, size: np.array([r["x"] for r in each.select(F.posexplode(c).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()] or [0] * size, dtype=np.int64)
    levels, form_n, form_v = summed("levels", 1024), summed("form_n", FORMS), summed("form_v", FORMS)
    above = np.cumsum(levels[::-1])[::-1]
    few = np.flatnonzero(above <= min(OWN_RATE * n**0.5, OWN_MOST))
    top = frequent(totals, int(few[0]) if len(few) else 1024).orderBy(F.desc("n"), "hash").collect()
    delete_written(each.sparkSession, each)
    counts = np.array([r["n"] for r in top], dtype=np.int64)
    for r in top:
        form_n[r["form"]] -= r["n"]
        form_v[r["form"]] -= 1
    hashes = np.array([r["hash"] for r in top], dtype=np.int64).view(np.uint64)
    # classes of like weight, by the roots of the counts
    share = np.cumsum(counts**0.5) / max((counts**0.5).sum(), 1)
    many = int(len(top) ** 0.5 / 2)
    begin = np.unique(np.concatenate(([0], np.searchsorted(share, np.arange(1, many) / max(many, 1)), [len(top)])))
    order = np.argsort(hashes)
    return Corpus(int(n), int(v), hashes[order], order, counts, begin, form_n, form_v)


def segments(ends: np.ndarray) -> np.ndarray:
    """Begins of the documents and of every further HISTORY tokens of one, and the end."""
    first = np.concatenate(([0], ends[:-1]))
    many = -(-(ends - first) // HISTORY)
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.append(np.repeat(first, many) + within * HISTORY, ends[-1:] if len(ends) else 0)


def steps(begins: np.ndarray, size: int = BATCH) -> list[tuple[int, int]]:
    """Runs of whole segments, of ``size`` tokens about, as ranges of ``begins``."""
    out, low = [], 0
    while low < len(begins) - 1:
        high = max(low + 1, int(np.searchsorted(begins, begins[low] + size, side="right")) - 1)
        out.append((low, high))
        low = high
    return out


@dataclass
class Bilinear:
    """Vectors r of the units as context, c of classes and w of tokens as what is predicted, with biases; diagonal maps of the context's places."""

    r: np.ndarray
    maps: np.ndarray
    c: np.ndarray
    cb: np.ndarray
    w: np.ndarray
    wb: np.ndarray

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.r, self.maps, self.c, self.cb, self.w, self.wb

    def context(self, units: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """Units one and two places before every token, its segment's begin, how many tokens its history has, and that history's mean."""
        mark = len(self.r) - 1
        at = np.arange(len(units))
        first = np.repeat(begins[:-1], np.diff(begins))
        one, two = np.full(len(units), mark), np.full(len(units), mark)
        one[1:], two[2:] = units[:-1], units[:-2]
        one[begins[:-1]] = two[begins[:-1]] = mark
        two[np.minimum(begins[:-1] + 1, len(units) - 1)] = mark
        seen = np.maximum(at - first, 1).astype(np.float32)
        before = np.zeros((len(units) + 1, self.r.shape[1]))
        np.cumsum(self.r.take(units, axis=0), axis=0, out=before[1:])
        mean = ((before[:-1] - before.take(first, axis=0)) / seen[:, None]).astype(np.float32)
        return one, two, first, seen, mean

    def predicted(self, one: np.ndarray, two: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return self.r.take(one, axis=0) * self.maps[0] + self.r.take(two, axis=0) * self.maps[1] + mean * self.maps[2]

    def log_prob(self, units: np.ndarray, ends: np.ndarray, stats: Corpus) -> np.ndarray:
        """Natural logarithms of the normalised probabilities of units; for a form, of the form."""
        out = np.empty(len(units))
        begins = segments(ends)
        classes = stats.class_of(np.arange(stats.words + FORMS))
        for low, high in steps(begins, 16 * BATCH):
            a, b = begins[low], begins[high]
            own = units[a:b]
            kind = classes.take(own)
            p, value = np.empty((len(own), self.r.shape[1]), dtype=np.float32), np.empty(len(own))
            for near, far in steps(begins[low : high + 1]):  # classes of few tokens at once, which stay in the cache
                edges = begins[low + near : low + far + 1] - a
                i = slice(edges[0], edges[-1])
                one, two, _, _, mean = self.context(own[i], edges - edges[0])
                p[i] = self.predicted(one, two, mean)
                value[i] = log_softmax(p[i] @ self.c.T + self.cb, kind[i])
            order = by_value(kind)
            cut = np.searchsorted(kind[order], np.arange(len(stats.begin)))
            for k in np.flatnonzero(np.diff(cut)):
                i, members = order[cut[k] : cut[k + 1]], slice(stats.begin[k], stats.begin[k + 1])
                value[i] += log_softmax(p.take(i, axis=0) @ self.w[members].T + self.wb[members], own[i] - stats.begin[k])
            out[a:b] = value
        return out


def log_softmax(s: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithms of the chosen columns' shares; ``s`` is overwritten."""
    own = s[np.arange(len(s)), chosen].astype(np.float64)
    top = s.max()
    if top - s.min() > 80:  # one shift for all rows would lose the small ones
        top = s.max(axis=1)
        s -= top[:, None]
    else:
        s -= top
    np.exp(s, out=s)
    return own - top - np.log(s @ np.ones(s.shape[1], dtype=s.dtype))


def fresh(stats: Corpus, dim: int = DIM, seed: int = 5) -> Bilinear:
    rng = np.random.default_rng(seed)
    normal = lambda n: rng.normal(scale=0.1, size=(n, dim)).astype(np.float32)
    n = stats.class_n()
    share = (n + SMOOTH) / (n.sum() + SMOOTH * len(n))
    return Bilinear(normal(stats.words + FORMS + 1), np.ones((3, dim), dtype=np.float32), normal(stats.classes), np.log(share).astype(np.float32), normal(stats.words), np.log(np.maximum(stats.unit_n, 1)).astype(np.float32))


def scatter(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct indexes, sums of their ``rows``)."""
    order = by_value(index)
    rising = index.take(order)
    new = np.concatenate(([True], rising[1:] > rising[:-1]))
    place = np.empty(len(index), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    own = rising[new]
    out = np.empty((len(own), rows.shape[1]), dtype=np.float32)
    for k in range(rows.shape[1]):
        out[:, k] = np.bincount(place, weights=rows[:, k])
    return own, out


def by_value(index: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 on; those of 16 bits are sorted by their digits, which is faster."""
    return np.argsort(index.astype(np.uint16) if len(index) and index.max() < 1 << 16 else index, kind="stable")


def nce(model: Bilinear, stats: Corpus, units: np.ndarray, ends: np.ndarray, rate: float, seed: int) -> Bilinear:
    """One pass of noise-contrastive estimation over documents, by Adagrad.

    Noise comes from the shares of classes, and of tokens within a class. There are few enough classes to take the
    expectation over the noise; tokens of a class are drawn.
    """
    rng = np.random.default_rng(seed)
    new = Bilinear(*(x.copy() for x in model.parts()))
    r, maps, c, cb, w, wb = new.parts()
    sums = [np.full(x.shape, 1e-2, dtype=np.float32) for x in new.parts()]
    n = stats.class_n()
    share = ((n + SMOOTH) / (n.sum() + SMOOTH * len(n)) * NOISE).astype(np.float32)
    log_share = np.log(share)
    mass = np.concatenate(([0], np.cumsum(stats.unit_n)))  # draws of a token from its class
    begins = segments(ends)
    classes = stats.class_of(np.arange(stats.words + FORMS))

    def step(k: int, grad: np.ndarray, at: np.ndarray | None = None) -> None:
        x, total = new.parts()[k], sums[k]
        move = grad * grad
        move += total if at is None else total.take(at, axis=0)
        total[slice(None) if at is None else at] = move
        np.sqrt(move, out=move)
        np.divide(grad, move, out=move)
        move *= rate
        move += x if at is None else x.take(at, axis=0)
        x[slice(None) if at is None else at] = move

    for low, high in steps(begins):
        a, b = begins[low], begins[high]
        own = units[a:b]
        edges = begins[low : high + 1] - a
        one, two, first, seen, mean = new.context(own, edges)
        p = new.predicted(one, two, mean)
        kind = classes.take(own)
        odds = p @ c.T
        odds += cb - log_share
        np.clip(odds, -30, 30, out=odds)
        np.exp(odds, out=odds)
        good = 1 / (1 + odds[np.arange(len(own)), kind])
        odds /= 1 + odds
        odds *= -share
        odds[np.arange(len(own)), kind] += good
        back = odds @ c
        gc, gcb = odds.T @ p, odds.sum(axis=0)
        is_word = np.flatnonzero(own < stats.words)
        if len(is_word):
            word, k = own[is_word], kind[is_word]
            low_mass, high_mass = mass[stats.begin[k]], mass[stats.begin[k + 1]]
            drawn = np.searchsorted(mass, low_mass[:, None] + rng.random((len(word), DRAWN)) * (high_mass - low_mass)[:, None], side="right") - 1
            both = np.concatenate((word[:, None], np.minimum(drawn, stats.words - 1)), axis=1)
            log_noise = np.log(DRAWN * stats.unit_n[both] / (high_mass - low_mass)[:, None])
            q = w.take(both, axis=0)
            pull = p.take(is_word, axis=0)
            s = 1 / (1 + np.exp(-np.clip(np.einsum("ijk,ik->ij", q, pull) + wb[both] - np.log((high_mass - low_mass)[:, None]) - log_noise, -30, 30)))
            s = -s
            s[:, 0] += 1
            s = s.astype(np.float32)
            back[is_word] += np.einsum("ij,ijk->ik", s, q)
            at, gw = scatter(both.ravel(), np.concatenate((s[:, :, None] * pull[:, None, :], s[:, :, None]), axis=2).reshape(-1, p.shape[1] + 1))
            step(4, gw[:, :-1], at)
            step(5, gw[:, -1], at)
        # a token is in the history of those after it in its segment
        far = np.zeros((len(own) + 1, p.shape[1]))
        np.cumsum((back * maps[2] / seen[:, None])[::-1], axis=0, out=far[1:])
        last = np.repeat(edges[1:], np.diff(edges))
        far = (far[-2::-1] - far.take(len(own) - last, axis=0)).astype(np.float32)
        at, gr = scatter(np.concatenate((one, two, own)), np.concatenate((back * maps[0], back * maps[1], far)))
        gm = np.stack([np.einsum("ij,ij->j", back, x) for x in (r.take(one, axis=0), r.take(two, axis=0), mean)])
        step(0, gr, at)
        step(1, gm / 10)
        step(2, gc)
        step(3, gcb)
    return new


def train(table: DataFrame, stats: Corpus, rounds: int = ROUNDS) -> Bilinear:
    """Rounds of parameter mixing over the chunks.

    In a round every chunk trains, from the same model, on the documents whose number in the chunk falls in the round.
    A row of the next model moves by the mean of the moves, weighted by how often a chunk has the row's unit. Chunks, not
    partitions, are the units of work, so that the input's layout changes nothing but the order of sums of doubles.
    """
    model = fresh(stats)
    shapes = [x.shape for x in model.parts()]

    def weights(units: np.ndarray) -> list[np.ndarray]:
        """How much a chunk's move of each row of the model counts."""
        n = np.bincount(units, minlength=stats.words + FORMS + 1).astype(float)
        n[-1] = len(units)
        kinds = np.bincount(stats.class_of(units), minlength=stats.classes) + 1e-6 * len(units)
        words = n[: stats.words] + 1e-6 * len(units)
        return [n, np.full(3, float(len(units))), kinds, kinds, words, words]

    for at_round in range(rounds):

        def run(batches, model=model, at_round=at_round):
            moved, weighed = [np.zeros(s) for s in shapes], [np.zeros(s[0]) for s in shapes]
            some = False
            for batch in batches:
                for number, hashes, forms, tokens, ends, held in each_row(batch, "number", "hashes", "forms", "tokens", "ends", "held"):
                    ends, held = np.frombuffer(ends, "<i8"), np.frombuffer(held, bool)
                    docs = np.flatnonzero(~held)[at_round::rounds]
                    sizes = np.diff(np.concatenate(([0], ends)))
                    chosen = np.zeros(len(held), dtype=bool)
                    chosen[docs] = True
                    units = stats.units_of(np.frombuffer(hashes, np.uint64), np.frombuffer(forms, np.uint8))[np.frombuffer(tokens, np.uint32)[np.repeat(chosen, sizes)]]
                    if not len(units):
                        continue
                    some = True
                    new = nce(model, stats, units, np.cumsum(sizes[docs]), RATE / (1 + at_round) ** 0.5, number % (1 << 31) * rounds + at_round)
                    for x, y, z, total, weight in zip(new.parts(), model.parts(), weights(units), moved, weighed, strict=True):
                        total += (x.astype(float) - y) * (z[:, None] if x.ndim == 2 else z)
                        weight += z
            if some:
                flat = np.concatenate([x.ravel() for x in (*moved, *weighed)])
                for part, low in enumerate(range(0, len(flat), 1 << 16)):
                    yield pa.RecordBatch.from_pylist([{"part": part, "x": flat[low : low + (1 << 16)].astype(np.float32).tobytes()}], schema=pa.schema([("part", pa.int32()), ("x", pa.binary())]))

        each = table.where("n_train > 0").select("number", "hashes", "forms", "tokens", "ends", "held").mapInArrow(run, "part int, x binary")

        def total(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [part["part"].iat[0]], "x": [np.sum([np.frombuffer(x, np.float32) for x in part["x"]], axis=0, dtype=float).tobytes()]})

        parts = each.groupBy("part").applyInPandas(total, "part int, x binary").orderBy("part").collect()  # of the model's size
        if not parts:
            return model
        flat = np.concatenate([np.frombuffer(r["x"]) for r in parts])
        cut = np.cumsum([int(np.prod(s)) for s in shapes] + [s[0] for s in shapes])[:-1]
        found = np.split(flat, cut)
        moved, weighed = found[: len(shapes)], found[len(shapes) :]
        model = Bilinear(*(
            (x + m.reshape(x.shape) / np.maximum(z if x.ndim == 1 else z[:, None], 1e-12)).astype(np.float32)
            for x, m, z in zip(model.parts(), moved, weighed, strict=True)
        ))
    return model


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, folds: int = 10, held_out_fold: int = 0) -> DataFrame:
    """One row per document: tokens with the end, tokens known from training, N, and log10 probabilities by counts and by the model.

    Learns from documents outside the held-out fold; a document without id is learned from. Null and empty texts
    have the end token alone. Repeated rows are documents of their own, and count each in training. Columns other
    than doc_id and text are not read.
    """
    table = written(chunks(docs, folds, held_out_fold), "lm-chunks")
    distinct, many = table.agg(F.coalesce(F.sum("n_distinct"), F.lit(0)), F.count("*")).first()
    buckets = buckets_for(distinct, BUCKET_TOKENS)
    totals = written(added_up(table, buckets), "lm-totals")
    stats = corpus(totals)
    model = train(table, stats)
    n, v = stats.n, stats.v
    floor = n + SMOOTH * (v + 1)
    form_mass = np.log(stats.form_n + SMOOTH * (stats.form_v + 1))

    def run(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in own.itertuples():
            total = np.concatenate([np.frombuffer(t, "<i8") for t in back.sort_values("bucket")["total"]])
            tokens, ends = np.frombuffer(x.tokens, np.uint32), np.frombuffer(x.ends, "<i8")
            forms = np.frombuffer(x.forms, np.uint8)
            units = stats.units_of(np.frombuffer(x.hashes, np.uint64), forms)
            base = np.log10((total + SMOOTH) / floor)
            within = np.where(units < stats.words, 0.0, np.log(total + SMOOTH) - form_mass[forms])
            first = np.concatenate(([0], ends[:-1]))
            each = (model.log_prob(units[tokens], ends, stats) + within[tokens]) / np.log(10)
            ids = np.frombuffer(x.doc_ids, "<i8")
            out.append(pd.DataFrame({
                "doc_id": pd.array(np.where(np.frombuffer(x.has_id, bool), ids, 0), dtype="Int64").copy(),
                "held_out": np.frombuffer(x.held, bool), "n_tokens": np.diff(np.append(first, ends[-1])), "n_known": np.add.reduceat((total > 0)[tokens].astype(np.int64), first),
                "train_tokens": n, "base_score": np.add.reduceat(base[tokens], first), "score": np.add.reduceat(each, first),
            }))
            out[-1].loc[~np.frombuffer(x.has_id, bool), "doc_id"] = pd.NA
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})

    replies = totals.where("chunk is not null").select("chunk", "bucket", "total")
    asked = table.select("chunk", "doc_ids", "has_id", "held", "ends", "tokens", "hashes", "forms")
    asked, replies = (spread(x, max(many, 1), "chunk") for x in (asked, replies))
    return asked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(run, RESULT)
