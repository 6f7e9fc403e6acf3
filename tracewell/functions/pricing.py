"""Token prices and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dollars for a million tokens (input, output, cache creation, cache read), by parts of the model's name, first match wins.
RATES = (
    (("opus-4-6", "opus-4-5"), (5.0, 25.0, 6.25, 0.5)),
    (("opus",), (15.0, 75.0, 18.75, 1.5)),
    (("sonnet",), (3.0, 15.0, 3.75, 0.3)),
    (("haiku-4-5", "haiku-4-6"), (1.0, 5.0, 1.25, 0.1)),
    (("haiku",), (0.8, 4.0, 1.0, 0.08)),
)
DEFAULT_RATES = (3.0, 15.0, 3.75, 0.3)
#: Context windows in tokens by parts of the model's name, first match wins.
CONTEXT_LIMITS = (
    (("opus", "sonnet", "haiku"), 200_000),
    (("gpt-4o",), 128_000),
    (("gpt-4-turbo",), 128_000),
    (("gpt-4",), 8_192),
    (("gemini-2",), 1_000_000),
    (("gemini-1.5",), 1_000_000),
    (("deepseek",), 128_000),
)
SYNTHETIC = "<synthetic>"


def _ladder(model: Column, table, value, otherwise: Column) -> Column:
    out = None
    low = F.lower(model)
    for parts, v in table:
        hit = low.contains(parts[0])
        for p in parts[1:]:
            hit = hit | low.contains(p)
        out = F.when(hit, value(v)) if out is None else out.when(hit, value(v))
    return out.otherwise(otherwise)


def rates(model: Column) -> Column:
    """The four rates of a model as a struct; unknown and null names have the default ones."""
    def struct(v):
        return F.struct(*(F.lit(x).alias(n) for x, n in zip(v, ("input", "output", "cache_creation", "cache_read"), strict=True)))

    return _ladder(model, RATES, struct, struct(DEFAULT_RATES))


def context_limit(model: Column) -> Column:
    return _ladder(model, CONTEXT_LIMITS, F.lit, F.lit(None).cast("int"))


def cost(model: Column, input: Column, output: Column, cache_creation: Column, cache_read: Column) -> Column:
    """Dollars (P44)."""
    r = rates(model)
    return (input * r["input"] + output * r["output"] + cache_creation * r["cache_creation"] + cache_read * r["cache_read"]) / 1_000_000
