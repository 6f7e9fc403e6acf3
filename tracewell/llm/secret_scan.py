"""Secrets: fixed forms, and windows of high Shannon entropy within candidate strings, less an allow-list."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import text as tx

#: Base kinds, in the order that breaks ties between spans with one start.
BASE_KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run that is too short fails from all its characters, so only its first is tried: linear on any text.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: Strings whose windows are measured.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

#: Added kinds: (kind, characters, characters in a window, least bits a character, kinds of character that each window holds).
#: A window of 24 random characters has 3.4 bits over 16 characters, 4.0 over 36 and 4.2 over 64; long words have up to 3.7.
CLASSES = (
    ("entropy_hex", r"[0-9A-Fa-f]+", 24, 3.0, ("0-9", "A-Fa-f")),
    ("entropy_base36", r"[0-9a-z]+|[0-9A-Z]+", 24, 3.6, ("0-9", "A-Za-z")),
    ("entropy_base64", r"[A-Za-z0-9+/_=-]+", 24, 3.9, ("0-9", "A-Z", "a-z")),
)
KINDS = BASE_KINDS + tuple(c[0] for c in CLASSES)

#: Known harmless strings: a candidate is left out if one of the first kind is found in it, or one of the second ends right before it.
ALLOWED = (
    r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",  # UUID
    r"(?i:example|placeholder|changeme|0123456789|abcdefghij)",
    r"^(?i:sha(?:1|224|256|384|512)|md5)-",  # digests in their public form
)
ALLOWED_BEFORE = (r"(?i:sha(?:1|224|256|384|512)|md5)[\x20:=]{1,2}$", r";base64,$", r"://[^\s?]*$")
BEFORE = 120

_UNIT = 1 << 20
_PIECE, _BLOCK = 64, 1 << 14


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted. Matches that fail their check are dropped without another try."""
    lower = text.lower()
    out = []
    if any(w in lower for w in _ASSIGN_WORDS):
        out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def window_entropy(codes: np.ndarray, size: int) -> np.ndarray:
    """Bits a character of every window of ``size`` codes in each row, times 2**20, by one count less and one more a step."""
    rows, n = codes.shape
    weigh = np.round(_UNIT * np.arange(size + 1) * np.log2(np.maximum(np.arange(size + 1), 1))).astype(np.int64)  # c log2 c; whole numbers, so sums don't drift
    counts = np.zeros((rows, 128), dtype=np.int16)
    row = np.arange(rows)
    for j in range(size):
        counts[row, codes[:, j]] += 1
    total = weigh[counts].sum(axis=1)
    out = np.empty((rows, n - size + 1), dtype=np.int64)
    out[:, 0] = total
    for j in range(n - size):
        old, new = codes[:, j], codes[:, j + size]
        c = counts[row, old]
        total += weigh[c - 1] - weigh[c]
        counts[row, old] = c - 1
        c = counts[row, new]
        total += weigh[c + 1] - weigh[c]
        counts[row, new] = c + 1
        out[:, j + 1] = total
    return (weigh[size] - out) // size


def kind_mask(kinds: tuple[str, ...]) -> np.ndarray:
    """Which of the 128 codes belong to each kind."""
    return np.array([[bool(re.match(f"[{k}]", chr(c))) for c in range(128)] for k in kinds])


def high_windows(runs: list[bytes], size: int, bits: float, kinds: tuple[str, ...]) -> list[list[tuple[int, int, float]]]:
    """For each run of at least ``size`` bytes its (start, end, most bits): joined windows of enough entropy that hold all kinds."""
    found: list[list[tuple[int, int, float]]] = [[] for _ in runs]
    masks = kind_mask(kinds)
    pieces = [(k, at) for k, r in enumerate(runs) for at in range(0, len(r) - size + 1, _PIECE)]
    for low in range(0, len(pieces), _BLOCK):
        part = pieces[low : low + _BLOCK]
        width = _PIECE + size - 1
        codes = np.frombuffer(b"".join(runs[k][at : at + width].ljust(width, b"\0") for k, at in part), np.uint8).reshape(len(part), width)
        level = window_entropy(codes, size)
        good = level >= bits * _UNIT
        for mask in masks:
            seen = np.zeros((len(part), width + 1), dtype=np.int32)
            np.cumsum(mask[codes], axis=1, out=seen[:, 1:])
            good &= seen[:, size:] > seen[:, :-size]
        good &= np.array([at for _, at in part])[:, None] + np.arange(_PIECE) + size <= np.array([len(runs[k]) for k, _ in part])[:, None]
        for i, j in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
            k, at = part[i]
            start, value, spans = at + j, level[i, j] / _UNIT, found[k]
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], start + size, max(spans[-1][2], value))
            else:
                spans.append((start, start + size, value))
    return found


def find(texts: list[str], allowed: tuple[str, ...] = ALLOWED, allowed_before: tuple[str, ...] = ALLOWED_BEFORE) -> list[list[tuple[int, int, int, float | None]]]:
    """For each text its spans (start, rank of the kind, end, bits a character), sorted; base kinds have no bits and always stay.

    Windows are joined where they touch. An added span within another span is left out.
    """
    out: list[list[tuple[int, int, int, float | None]]] = [[(s, k, e, None) for s, k, e in base_spans(t)] for t in texts]
    inside = re.compile("|".join(allowed)) if allowed else None
    before = re.compile("|".join(allowed_before)) if allowed_before else None
    candidates = []
    for i, text in enumerate(texts):
        for m in _CANDIDATE.finditer(text):
            if not (inside and inside.search(m[0])) and not (before and before.search(text[max(0, m.start() - BEFORE) : m.start()])):
                candidates.append((i, m.start(), m[0]))
    for rank, (_, characters, size, bits, kinds) in enumerate(CLASSES, len(BASE_KINDS)):
        pattern = re.compile(characters)
        runs = [(i, at + m.start(), m[0]) for i, at, s in candidates for m in pattern.finditer(s) if m.end() - m.start() >= size]
        for (i, at, _), spans in zip(runs, high_windows([r.encode() for *_, r in runs], size, bits, kinds), strict=True):
            out[i] += [(at + s, rank, at + e, level) for s, e, level in spans]
    return [apart(spans) for spans in out]


def apart(spans: list[tuple[int, int, int, float | None]]) -> list[tuple[int, int, int, float | None]]:
    """Sorted by start and kind, without added spans that lie within another span; of equal ones the first kind stays."""
    kept = []
    reach = [-1] * len(KINDS)  # the furthest end of each kind among spans that start no later
    for s, k, e, level in sorted(spans, key=lambda x: (x[0], -x[2], x[1])):
        if k < len(BASE_KINDS) or max(reach) < e:
            kept.append((s, k, e, level))
        reach[k] = max(reach[k], e)
    return sorted(kept, key=lambda x: x[:3])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("bits", T.DoubleType())])
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])


def scan(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, allowed_before: tuple[str, ...] = ALLOWED_BEFORE) -> DataFrame:
    """(doc_id, spans) for every row: an array of (kind, start, end, bits), by start, then kind.

    Null and empty texts have no spans. Positions are code points, ends exclusive. Repeated rows give repeated results;
    a null doc_id stays null; columns other than doc_id and text are not read.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                found = find([t or "" for t in part.column(1).to_pylist()], allowed, allowed_before)
                rows = [[{"kind": KINDS[k], "start": s, "end": e, "bits": bits} for s, k, e, bits in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(rows, type=pa.list_(span))], names=RESULT.names)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
