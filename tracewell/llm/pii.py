"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Base kinds, in the order that breaks ties between spans with one start.
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match that fails from the first digit of a run fails from all others, so only the first is tried: linear on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Words that make a kind likelier when they stand within ``CONTEXT`` characters before a span.
CONTEXT = 40
CONTEXT_WORDS = {
    "email": re.compile(r"(?i)mail|contact|write|schreib|écri|correo"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server|adresse|dirección"),
    "card": re.compile(r"(?i)card|visa|credit|pay|karte|carte|tarjeta"),
    "phone": re.compile(r"(?i)phone|call|tel|mobile|fax|anruf|appel|llam"),
    "iban": re.compile(r"(?i)iban|account|bank|konto|compte|cuenta"),
    "ssn": re.compile(r"(?i)ssn|social|security|number"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
LIFT = 0.2


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The IBAN check: country and check digits to the end, letters as 10 to 35, remainder 1."""
    code = code.replace(" ", "")
    if not 15 <= len(code) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards, so that a text is read once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        else:
            last = at + 1  # the run before this @ can't reach over it
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted. Matches that fail their check are dropped without another try."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def find(text: str, threshold: float = 0.5) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score). Base kinds always stay; further kinds stay at ``threshold`` or more."""
    base = base_spans(text)
    found = [(s, k, e) for s, k, e in base]
    for k, pattern, check in ((4, _IBAN, mod97), (5, _SSN, None)):
        for m in pattern.finditer(text):
            if check is None or check(m[0]):
                found.append((m.start(), k, m.end()))
    kinds = BASE_KINDS + EXTRA_KINDS
    out = []
    for s, k, e in sorted(found):
        kind = kinds[k]
        near = CONTEXT_WORDS[kind].search(text, max(0, s - CONTEXT), s)
        score = min(1.0, PRIOR[kind] + (LIFT if near else 0.0))
        if k < len(BASE_KINDS) or score >= threshold:
            out.append((s, kind, e, score))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e, _ in spans)


RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
    + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    + [T.StructField("scores", T.ArrayType(T.DoubleType()))]
)


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans with scores.

    Null and empty texts have no spans. Positions are code points, ends exclusive. Repeated rows give
    repeated results; a null doc_id stays null; columns other than doc_id and text are not read.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spans = find(text.as_py() or "", threshold)
                base = [x for x in spans if x[1] in BASE_KINDS]
                n = [sum(x[1] == k for x in base) for k in BASE_KINDS]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((doc, *n, digest, _joined(spans), [x[3] for x in spans]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], type=t) for t in _ARROW],
                names=RESULT.names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


_ARROW = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.float64())]


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets; n_chars follows the text where there is one.

    Of overlapping spans the one that starts first covers the others. Null texts stay null.
    """
    schema = docs.schema
    at = schema.names.index("text")
    count_at = schema.names.index("n_chars") if "n_chars" in schema.names else None

    def run(batches):
        for batch in batches:
            new, sizes = [], []
            for text in batch.column(at):
                text = text.as_py()
                spans = find(text, threshold) if text else []
                if spans:
                    parts, last = [], 0
                    for s, kind, e, _ in spans:
                        if s >= last:
                            parts += [text[last:s], f"[{kind.upper()}]"]
                        elif e <= last:
                            continue
                        last = max(last, e)
                    text = "".join(parts) + text[last:]
                new.append(text)
                sizes.append(None if text is None else len(text))
            columns = batch.columns
            columns[at] = pa.array(new, type=batch.schema.field(at).type)
            if count_at is not None:
                kind = batch.schema.field(count_at).type
                columns[count_at] = pa.array(sizes, type=pa.int64()).cast(kind) if pa.types.is_integer(kind) else columns[count_at]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
