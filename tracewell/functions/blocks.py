"""Diffs, patches and pieces of JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import diff, partial_json

#: Type objects, since a string would need a session when this module is imported.
DIFF = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("line", T.StringType())]))


def line_count(text: Column) -> Column:
    """Lines of a text; none in an empty or null one."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, "\n")))


def line_delta(old: Column, new: Column) -> Column:
    """Net growth in lines."""
    return line_count(new) - line_count(old)


@F.pandas_udf(DIFF)
def line_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Lines kept, removed and added, in order, with the fewest edits (P52); null counts as empty."""

    def one(a: str | None, b: str | None) -> list[dict]:
        sides = (x.split("\n") if x else [] for x in (a, b))
        return [{"kind": kind, "line": line} for kind, line in diff.edits(*sides)]

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)], dtype=object)


def patch_sides(patch: Column) -> Column:
    """(file, old, new) of a patch: removed and added lines of its hunks, unchanged ones on both sides."""
    lines = F.split(patch, "\n")
    named = F.nullif(F.regexp_extract(patch, r"(?m)^(?:\*\*\* (?:Update|Add|Delete) File: |\+\+\+ (?:b/)?)(.+)$", 1), F.lit(""))
    body = F.filter(lines, lambda x: x.rlike(r"^[ +-]") & ~x.rlike(r"^(?:\+\+\+|---) "))

    def side(sign: str) -> Column:
        return F.array_join(F.transform(F.filter(body, lambda x: x.startswith(sign) | x.startswith(" ")), lambda x: F.substring(x, 2, 1 << 30)), "\n")

    return F.struct(named.alias("file"), side("-").alias("old"), side("+").alias("new"))


@F.pandas_udf(T.StringType())
def first_json(text: pd.Series) -> pd.Series:
    """The first whole JSON object inside a text, else null."""
    return text.map(lambda s: partial_json.read(s) if s else None)


@F.pandas_udf(T.StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    """As ``first_json``, but an object that the text's end cuts comes closed after its last whole member."""
    return text.map(lambda s: partial_json.read(s, repair=True) if s else None)
