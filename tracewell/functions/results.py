"""What a tool's result tells: its text, whether the tool failed and how long it ran, at any depth of nested JSON."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLD = T.StructType([T.StructField("text", T.StringType()), T.StructField("failed", T.BooleanType()), T.StructField("ms", T.LongType())])
#: Where a result holds its text, in the order in which they are looked at, and its time.
TEXTS, TIMES = ("output", "contents", "markdown"), ("localExecutionTimeMs", "executionTimeMs", "executionTime")


def parsed(raw: str) -> object:
    """The JSON value of a text; None where it isn't JSON."""

    def number(s: str) -> float | int:
        x = float(s)
        return int(x) if math.isfinite(x) and x == int(x) else x

    def no(s: str) -> None:
        raise ValueError(s)

    try:
        return json.loads(raw, parse_float=number, parse_constant=no)
    except (ValueError, RecursionError):
        return None


def text_of(value: object) -> str:
    """Texts of lists are joined by line feeds, JSON within text is read on; an object without a text is shown itself."""
    if isinstance(value, str):
        inner = parsed(value)
        return text_of(inner) if inner else value
    if isinstance(value, list):
        return "\n".join(x for x in map(text_of, value) if x)
    if not isinstance(value, dict):
        return ""
    for name in TEXTS:
        found = value.get(name)
        if isinstance(found, str) and found.strip():
            code = value.get("exitCode")
            return f"{found}\n[exitCode: {code}]" if name == "output" and isinstance(code, (int, float)) and not isinstance(code, bool) else found
    result = value.get("result")
    if isinstance(result, str) and result.strip():
        inner = parsed(result)
        nested = text_of(inner) if inner else ""
        return nested if nested.strip() else result
    if isinstance(value.get("content"), list):
        some = [x["text"] for x in value["content"] if isinstance(x, dict) and isinstance(x.get("text"), str) and x["text"]]
        if some:
            return "\n".join(some)
    return json.dumps(value, indent=2, ensure_ascii=False)


def _some(value: object) -> bool:
    """Neither missing, false, 0 nor empty text; empty lists and objects are something."""
    return isinstance(value, (list, dict)) or bool(value)


def failed(value: object) -> bool:
    if isinstance(value, str):
        return failed(parsed(value)) if value else False
    if isinstance(value, list):
        return any(map(failed, value))
    if not isinstance(value, dict):
        return False
    error, output = value.get("error"), value.get("output")
    told = value.get("isError") is True or _some(value.get("failure")) or _some(value.get("rejected")) or error is True or isinstance(error, str) and bool(error.strip())
    return told or isinstance(output, dict) and (_some(output.get("failure")) or output.get("success") is False)


def positive_ms(value: object) -> int | None:
    try:
        x = float(value) if isinstance(value, (int, float, str)) and not isinstance(value, bool) else 0.0
    except ValueError:
        return None
    return round(x) if math.isfinite(x) and round(x) > 0 else None


def execution_ms(value: object) -> int | None:
    if isinstance(value, str):
        inner = parsed(value)
        return execution_ms(inner) if inner else positive_ms(value)
    if isinstance(value, list):
        return next((ms for ms in map(execution_ms, value) if ms is not None), None)
    if not isinstance(value, dict):
        return None
    direct = next((ms for ms in (positive_ms(value.get(n)) for n in TIMES) if ms is not None), None)
    output = value.get("output")
    if direct is not None or not isinstance(output, dict):
        return direct
    inner = execution_ms(output.get("success"))
    return inner if inner is not None else execution_ms(output.get("failure"))


@F.pandas_udf(TOLD)
def told(result: pd.Series) -> pd.DataFrame:
    """(text, failed, ms) of a tool's result (P5, P18); for null an empty text, no failure and no time."""

    def one(raw: str | None) -> tuple[str, bool, int | None]:
        value = (parsed(raw) if raw else None) or raw or ""
        try:
            return text_of(value), failed(value), execution_ms(value)
        except RecursionError:
            return raw, False, None

    return pd.DataFrame([one(x) for x in result], columns=["text", "failed", "ms"]).astype({"ms": "Int64"})
