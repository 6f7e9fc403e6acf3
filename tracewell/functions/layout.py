"""Lines of bounded width, where wide East Asian characters count twice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import WIDE, one_line

_WIDE = tuple((ord(r[0]), ord(r[-1])) for r in WIDE)


def _width(ch: str) -> int:
    code = ord(ch)
    return 2 if code >= _WIDE[0][0] and any(a <= code <= b for a, b in _WIDE) else 1


def _fit(text: str, width: int) -> int:
    """How many characters of ``text`` fit into ``width``."""
    used = 0
    for i, ch in enumerate(text):
        used += _width(ch)
        if used > width:
            return i
    return len(text)


def condensed_line(text: str, width: int) -> str:
    """``text`` on one line, cut with an ellipsis where it is wider."""
    text = " ".join(text.split())
    return text if _fit(text, width) == len(text) else text[: _fit(text, width - 1)] + "…"


def wrapped_lines(text: str, width: int, lines: int) -> list[str]:
    """At most ``lines`` lines, broken at the last blank that fits unless it stands in the first 30 % of the line; the last one ends with an ellipsis where text is left.

    Positions count characters beyond U+FFFF twice, as where the rule comes from.
    """
    rest = " ".join(text.split())
    out = []
    while len(out) < lines - 1 and _fit(rest, width) < len(rest):
        n = _fit(rest, width)
        units = lambda s: len(s) + sum(c > "￿" for c in s)
        blank = rest.rfind(" ", 0, n)
        at = blank if blank >= 0 and units(rest[:blank]) > units(rest[:n]) * 0.3 else n
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [*out, condensed_line(rest, width)] if rest or not out else out


def condense(text: Column, width: int) -> Column:
    """A text on one line of at most ``width``, an ellipsis where it was cut (P47); null for null."""

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda s: None if s is None else condensed_line(s, width))

    return run(F.substring(one_line(text), 1, width + 2))  # what lies beyond can't be shown


def wrap(text: Column, width: int, lines: int) -> Column:
    """Lines of at most ``width`` (P47); null for null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda s: None if s is None else wrapped_lines(s, width, lines))

    return run(F.substring(one_line(text), 1, (width + 2) * (lines + 1)))
