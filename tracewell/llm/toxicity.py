"""Toxicity by multiple-instance learning: sentences have scores, noisy-or joins them, document labels train them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import text as tx
from tracewell.llm.store import delete_written, written

#: Bytes that end a sentence.
ENDS = np.zeros(256, dtype=bool)
ENDS[[10, 33, 46, 63]] = True

#: The classifier is fitted on this many labelled documents of each class at most, those with the smallest hash of their id.
SAMPLE_PER_CLASS = 3000
FEATURES = 4096
#: Besides whole words, their first bytes count as features, so that inflected and compound forms share a weight.
BEGINNINGS = (4, 5, 6)


@dataclass
class Model:
    """Sorted word hashes, their weights, and the weight of a sentence without any of them. ``constant`` replaces them all."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None


def sentences(buf: np.ndarray, off: np.ndarray):
    """(start, end, doc, sentence number) of each word, and (word, hash) of each feature.

    Sentence numbers rise and never join two documents; features stand in the order of their words.
    """
    low = tx.lower_ascii(buf)
    start, end, doc = tx.words(low, off, tx.NOT_LETTER)
    sums = tx.prefix(low)
    own = np.arange(len(start))
    which, h = [own], [tx.spans(sums, start, end)]
    for k in BEGINNINGS:
        long = own[end - start > k]
        which.append(long)
        h.append(tx.spans(sums, start[long], start[long] + k) + np.uint64(k))
    which, h = np.concatenate(which), np.concatenate(h)
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(ENDS[buf])
    number = ends[start] + doc if len(start) else start
    if len(number):
        number = np.concatenate(([0], np.cumsum(number[1:] != number[:-1])))
    return start, end, doc, number, which[order], h[order]


def feature_counts(sample: DataFrame) -> DataFrame:
    """(word, a, n): in how many toxic documents and in how many documents of the sample each feature stands."""

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                y = part.column("y").to_numpy().astype(np.int64)
                _, _, doc, _, which, h = sentences(*tx.texts(part.column("text")))
                if not len(h):
                    continue
                _, at = np.unique(tx.mix(h ^ doc[which].astype(np.uint64)), return_index=True)  # once in a document
                word, index = np.unique(h[at], return_inverse=True)
                a = np.bincount(index, weights=y[doc[which[at]]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(a), pa.array(np.bincount(index))], names=["word", "a", "n"])

    return sample.select("y", "text").mapInArrow(run, "word bigint, a bigint, n bigint").groupBy("word").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))


def chosen_features(sample: DataFrame, share: float, features: int) -> np.ndarray:
    """Sorted hashes of the features whose counts deviate most, by chi-square, from the share of toxic documents."""
    expected = F.col("n") * share
    gain = (F.col("a") - expected) ** 2 / (expected * (1 - share))
    top = feature_counts(sample).where("n >= 3").select("word", gain.alias("gain")).where("gain > 0").orderBy(F.desc("gain"), "word").limit(features)
    return np.sort(np.array([r["word"] for r in top.collect()], dtype=np.int64).view(np.uint64))


def occurrences(sample: DataFrame, words: np.ndarray) -> DataFrame:
    """(y, number of sentences, sentences and features as packed 32-bit numbers) of each document of the sample."""

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                _, _, doc, number, which, h = sentences(*tx.texts(part.column("text")))
                n = part.num_rows
                first = np.searchsorted(doc, np.arange(n + 1))
                base = np.array([number[i] if i < len(number) else 0 for i in first[:-1]], dtype=np.int64)
                many = np.array([number[j - 1] - number[i] + 1 if j > i else 0 for i, j in zip(first[:-1], first[1:], strict=True)], dtype=np.int64)
                at, hit = lookup(words, h)
                key = np.unique(number[which[hit]] * np.int64(max(len(words), 1)) + at)
                row, col = key // max(len(words), 1), key % max(len(words), 1)
                owner = np.repeat(np.arange(n), many)[row] if len(row) else row
                cut = np.searchsorted(owner, np.arange(n + 1))
                own, col = (row - base[owner]).astype(np.int32), col.astype(np.int32)
                packed = [[x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for x in (own, col)]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(many), *(pa.array(x, type=pa.binary()) for x in packed)], names=["y", "many", "sentence", "feature"])

    return sample.select("y", "text").mapInArrow(run, "y int, many bigint, sentence binary, feature binary")


def lookup(words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``words``, place in ``h``) of the hashes that ``words`` has."""
    if not len(words):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = np.flatnonzero(words[at] == h)
    return at[hit], hit


def fit_rows(rows: list, words: np.ndarray, steps: int = 300, l2: float = 2e-5) -> Model:
    """Full-batch Adam on the log-likelihood of the document labels."""
    y = np.array([r["y"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, float(y[0]) if len(y) else 0.0)
    own = [np.frombuffer(r["sentence"], dtype=np.int32) for r in rows]
    many = np.array([r["many"] for r in rows])
    first = np.concatenate(([0], np.cumsum(many)[:-1]))
    row = np.concatenate([x + f for x, f in zip(own, first, strict=True)])
    col = np.concatenate([np.frombuffer(r["feature"], dtype=np.int32) for r in rows])
    sentence_doc = np.repeat(np.arange(len(rows)), many)
    w, b, total = np.zeros(len(words)), -4.0, len(sentence_doc)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = b + tx.sums(w[col], row, total)
        soft = np.logaddexp(0, z)
        joined = np.maximum(tx.sums(soft, sentence_doc, len(y)), 1e-9)
        pull = np.where(y == 1, 1 / np.expm1(np.minimum(joined, 500)), -1.0) / len(y)
        each = pull[sentence_doc] / (1 + np.exp(-z))
        g = np.append(tx.sums(each[row], col, len(w)) - l2 * w, each.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w + move[:-1], b + move[-1]
    return Model(words, w, float(b))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, features: int = FEATURES, held_out_fold: int | None = 0, folds: int = 5) -> Model:
    """Learn from labelled documents outside the held-out fold; of rows with one doc_id the highest label counts, null labels don't."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    if held_out_fold is not None:
        known = known.where(tx.fold("doc_id", folds) != held_out_fold)
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(pick[0].union(pick[1])), "doc_id")  # 2 * per_class ids at most
    sample = written(chosen.select("y", "text"), "toxicity-sample")
    n, positive = sample.agg(F.count("*"), F.sum("y")).first()
    share = (positive or 0) / max(n, 1)
    words = chosen_features(sample, share, features) if 0 < share < 1 else np.zeros(0, np.uint64)
    model = fit_rows(occurrences(sample, words).collect(), words)
    delete_written(docs.sparkSession, sample)
    return model


RESULT = "doc_id bigint, score double, n_sentences bigint, offending array<struct<start:bigint,end:bigint,score:double>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def score_slice(buf: np.ndarray, off: np.ndarray, model: Model):
    """Scores of documents, their numbers of sentences, and the sentences that score 0.5 or more as (doc, start, end, score) in bytes."""
    n = len(off) - 1
    start, end, doc, number, which, h = sentences(buf, off)
    if not len(start):
        return np.full(n, model.constant or 0.0), np.zeros(n, dtype=np.int64), (start,) * 3 + (np.zeros(0),)
    total = number[-1] + 1
    first = np.searchsorted(number, np.arange(total))
    last = np.append(first[1:], len(number)) - 1
    of = doc[first]
    count = np.bincount(of, minlength=n)
    if model.constant is not None or not len(model.words):
        z = np.full(total, model.bias)
    else:
        at, hit = lookup(model.words, h)
        key = np.unique(number[which[hit]] * np.int64(len(model.words)) + at)
        z = model.bias + tx.sums(model.weights[key % len(model.words)], key // len(model.words), total)
    p = 1 / (1 + np.exp(-z))
    score = -np.expm1(-tx.sums(np.logaddexp(0, z), of, n))
    if model.constant is not None:
        return np.full(n, model.constant), count, (start[:0],) * 3 + (np.zeros(0),)
    bad = np.flatnonzero(p >= 0.5)
    return score, count, (of[bad], start[first[bad]], end[last[bad]], p[bad])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: its score from 0 to 1, its number of sentences, and where the offending ones stand.

    Null and empty texts have no sentence and score 0. Positions are code points, ends exclusive. Repeated rows
    give repeated results; columns other than doc_id and text are not read.
    """

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                buf, off = tx.texts(part.column("text"))
                got, count, (of, start, end, p) = score_slice(buf, off, model)
                lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80))) if len(of) else None
                own = lead[off[of]] if len(of) else of
                spans = pa.StructArray.from_arrays(
                    [pa.array(lead[start] - own if len(of) else of, type=pa.int64()), pa.array(lead[end] - own if len(of) else of, type=pa.int64()), pa.array(p, type=pa.float64())],
                    fields=list(_SPAN),
                )
                cut = pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)), type=pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.clip(got, 0, 1)), pa.array(count, type=pa.int64()), pa.ListArray.from_arrays(cut, spans)],
                    names=["doc_id", "score", "n_sentences", "offending"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns; null and empty texts stay."""
    at = docs.schema.names.index("text")

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, batch.schema.names[at]):
                got, _, _ = score_slice(*tx.texts(part.column(at)), model)
                yield part.filter(pa.array(got < threshold))

    return docs.mapInArrow(run, docs.schema)
