"""Vectorised word splitting and hashing over Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return, blank.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes that belong to no word when words are letters only: ASCII that isn't a letter.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[128:] = NOT_LETTER[65:91] = NOT_LETTER[97:123] = False

_BASE = 0x9E3779B97F4A7C15
_U64 = np.uint64
_powers: dict[int, np.ndarray] = {}


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows whose texts hold about ``limit`` bytes; one longer text stands alone."""
    col = batch.column(column)
    sizes = np.diff(offsets(col))
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def offsets(col: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if not len(col):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offsets); a null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    off = offsets(col)
    data = col.buffers()[2] if len(col) else None
    if data is None or off[-1] == off[0]:
        return np.zeros(0, dtype=np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf)


def words(buf: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the maximal runs without gap bytes (ASCII white space); none crosses a document."""
    n = len(buf)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    gap = gaps[buf]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, gap[1:]
    start = np.flatnonzero(~gap & (before | first[:-1]))
    end = np.flatnonzero(~gap & (after | first[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def powers(n: int, base: int = _BASE) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=_U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def prefix(buf: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of a polynomial in ``base`` modulo 2**64; ``spans`` takes differences of it."""
    out = np.zeros(len(buf) + 1, dtype=_U64)
    np.cumsum((buf.astype(_U64) + _U64(1)) * powers(len(buf), base), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); equal bytes have equal hashes wherever they stand."""
    inverse = powers(len(sums), pow(base, -1, 1 << 64))
    raw = (sums[end] - sums[start]) * inverse[start]
    return mix(raw ^ ((end - start).astype(_U64) * _U64(0xD6E8FEB86659FD93)))


def word_hashes(buf: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, doc = words(buf, off, gaps)
    return start, end, doc, spans(prefix(buf), start, end)


def fold(column: str, modulus: int) -> Column:
    """crc32 of a number as text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sums(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by ``index`` as doubles, for indexes 0 to n-1."""
    return np.bincount(index, weights=values, minlength=n)
