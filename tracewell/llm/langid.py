"""Language identification by interpolated Kneser-Ney character models in sorted arrays of packed n-grams."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import text as tx

ORDER = 4
BITS = np.uint64(16)
#: Each language's model is fitted on about this many documents, chosen by a hash of their id.
SAMPLE_PER_LANGUAGE = 3000
#: Nats of cross-entropy a character that a text may lie above nearly all training texts before it counts as rejected.
MARGIN = 0.25
UNKNOWN = "und"


def grams(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray):
    """Distinct words' character 4-grams.

    Returns (packed 4-grams of each distinct word in turn, first 4-gram of each distinct word, word -> distinct word).
    A word has lower case, a mark before and after it; contexts don't reach over words. A 4-gram packs
    four characters of 16 bits, the predicted one last, zeros before the word.
    """
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    s, e = start[first], end[first]
    sizes = e - s + 1
    where = np.repeat(s - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    joined = buf[np.minimum(where, len(buf) - 1)]
    joined[np.cumsum(sizes) - 1] = 10
    chars = np.frombuffer(joined.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    chars = np.where(chars > 0xFFFF, 0xE000 + chars % 0x1900, chars).astype(np.uint64)  # into the private range, which never gives the mark
    stop = np.flatnonzero(chars == 10)
    begin = np.concatenate(([0], stop[:-1] + 1))
    age = np.arange(len(chars)) - np.repeat(begin, stop - begin + 1)
    packed = chars.copy()
    for k in range(1, ORDER):
        back = np.zeros_like(chars)
        back[k:] = chars[:-k]
        back[age < k] = 0
        back[age == k - 1] = 10  # the mark before the word
        packed |= back << np.uint64(16 * k)
    return packed, begin, inverse


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each language's sample has each packed 4-gram."""

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                buf, off = tx.texts(part.column("text"))
                start, end, doc, h = tx.word_hashes(buf, off, tx.NOT_LETTER)
                if not len(h):
                    continue
                packed, begin, inverse = grams(buf, start, end, h)
                size = np.diff(np.append(begin, len(packed)))
                langs, code = np.unique(np.array(part.column("lang").to_pylist()), return_inverse=True)
                for k, lang in enumerate(langs):
                    n = np.bincount(inverse[code[doc] == k], minlength=len(begin))
                    gram, at = np.unique(packed, return_inverse=True)
                    total = np.bincount(at, weights=np.repeat(n, size)).astype(np.int64)
                    some = total > 0
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * int(some.sum()), type=pa.string()), pa.array(gram[some].view(np.int64)), pa.array(total[some])], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """One order: sorted n-grams with discounted shares, and sorted contexts with the mass they leave to the order below."""

    gram: np.ndarray
    share: np.ndarray
    context: np.ndarray
    left: np.ndarray


@dataclass
class Language:
    name: str
    levels: list[Level]
    floor: float
    ceiling: float = np.inf

    def log_prob(self, packed: np.ndarray) -> np.ndarray:
        p = np.full(len(packed), self.floor)
        for k, level in enumerate(self.levels, 1):
            gram = packed & _mask(k)
            left = _find(level.context, gram >> BITS, level.left, 1.0)
            p = p * left + _find(level.gram, gram, level.share, 0.0)
        return np.log(p)


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (16 * k)) - 1)


def _find(keys: np.ndarray, want: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], missing)


def kneser_ney(name: str, gram: np.ndarray, n: np.ndarray) -> Language:
    """Counts at the highest order, numbers of distinct characters to the left below it, one discount an order."""
    order = np.argsort(gram)
    gram, n = gram[order], n[order].astype(float)
    levels = []
    for k in range(ORDER, 0, -1):
        context, at = np.unique(gram >> BITS, return_inverse=True)
        total, kinds = np.bincount(at, weights=n), np.bincount(at)
        ones, twos = (n == 1).sum(), (n == 2).sum()
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        levels.append(Level(gram, np.maximum(n - d, 0) / total[at], context, np.minimum(d * kinds / total, 1.0)))
        if k > 1:
            gram, many = np.unique(gram & _mask(k - 1), return_counts=True)
            n = many.astype(float)
    alphabet = len(levels[-1].gram) + 1
    return Language(name, levels[::-1], 1.0 / alphabet)


@dataclass
class Model:
    languages: list[Language] = field(default_factory=list)

    def entropies(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages) nats a character, and the number of predicted characters; a document without words has 0."""
        n = len(off) - 1
        start, end, doc, h = tx.word_hashes(buf, off, tx.NOT_LETTER)
        if not len(h):
            return np.zeros((n, len(self.languages))), np.zeros(n)
        packed, begin, inverse = grams(buf, start, end, h)
        unique, at = np.unique(packed, return_inverse=True)
        size = np.diff(np.append(begin, len(packed)))[inverse]
        many = tx.sums(size, doc, n)
        out = np.empty((n, len(self.languages)))
        for k, language in enumerate(self.languages):
            of_word = np.add.reduceat(language.log_prob(unique)[at], begin)
            out[:, k] = -tx.sums(of_word[inverse], doc, n) / np.maximum(many, 1)
        return out, many


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, held_out_fold: int | None = 2, folds: int = 4) -> Model:
    """Learn from documents with a language and a text outside the held-out fold, about ``per_language`` of each language."""
    known = docs.select("doc_id", "lang", "text").where("lang is not null and doc_id is not null and text is not null")
    if held_out_fold is not None:
        known = known.where(tx.fold("doc_id", folds) != held_out_fold)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model()
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    table = counted(sample).toPandas()
    model = Model()
    for lang, part in table.groupby("lang", sort=True):
        model.languages.append(kneser_ney(lang, part["gram"].to_numpy().view(np.uint64), part["n"].to_numpy()))
    if model.languages:
        typical = sample.select("lang", "text").mapInArrow(_own_entropies(model), "lang string, h double").groupBy("lang").agg(F.expr("percentile_approx(h, 0.995)").alias("h")).collect()
        known_h = {r["lang"]: r["h"] for r in typical}
        for language in model.languages:
            language.ceiling = known_h.get(language.name, np.inf) + MARGIN
    return model


def _own_entropies(model: Model):
    place = {x.name: k for k, x in enumerate(model.languages)}

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                h, many = model.entropies(*tx.texts(part.column("text")))
                langs = part.column("lang").to_pylist()
                keep = [i for i, x in enumerate(langs) if many[i] and x in place]
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in keep], type=pa.string()), pa.array([h[i, place[langs[i]]] for i in keep], type=pa.float64())], names=["lang", "h"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: the language of the lowest cross-entropy, its posterior, and whether calibration rejects it.

    A text that is null or has no letter gets ``und``, score 0 and rejected. A text whose letters are all of
    scripts without a model still gets the nearest language, and rejected. Ties go to the name that sorts first.
    Repeated rows give repeated results; columns other than doc_id and text are not read.
    """
    names = [x.name for x in model.languages]
    ceilings = np.array([x.ceiling for x in model.languages])

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                n = part.num_rows
                letters = np.array(part.column("letters").to_pylist(), dtype=bool)
                lang, score, off_model = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.ones(n, dtype=bool)
                if names:
                    h, many = model.entropies(*tx.texts(part.column("text")))
                    best = h.argmin(axis=1)
                    low = h[np.arange(n), best]
                    posterior = 1 / np.exp(np.clip((low[:, None] - h) * np.minimum(many, 200)[:, None], -700, 0)).sum(axis=1)
                    lang = np.where(letters, np.array(names, dtype=object)[best], UNKNOWN)
                    score = np.where(letters, posterior, 0.0)
                    off_model = ~letters | (many == 0) | (low > ceilings[best])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang.tolist(), type=pa.string()), pa.array(score), pa.array(off_model)], names=["doc_id", "lang_pred", "score", "rejected"])

    seen = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return seen.mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
