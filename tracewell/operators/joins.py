"""Joins by order, position, preference and presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], ts: str, right_id: str) -> DataFrame:
    """Each left row with the first right row of its keys at its time or later (J9): one sort instead of a range join."""
    rows = left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    ahead = W.partitionBy(*keys).orderBy(F.desc(ts), F.desc("__side")).rowsBetween(W.unboundedPreceding, W.currentRow)  # backwards: a frame that only grows
    hit = F.last(F.when(F.col("__side") == 1, F.struct(F.col(right_id).alias("id"), F.col(ts).alias("ts"))), ignorenulls=True).over(ahead)
    found = rows.withColumn("__hit", hit).where("__side = 0")
    return found.select(*left.columns, F.col("__hit.id").alias(f"next_{right_id}"), F.col("__hit.ts").alias(f"next_{ts}"))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "k") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def positional(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], how: str = "left") -> DataFrame:
    """The k-th row of either side together."""
    return numbered(left, keys, left_order).join(numbered(right, keys, right_order), [*keys, "k"], how)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def preferred(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], value: str) -> DataFrame:
    """``value`` of the right row with the first key, else of the one with the second: two equi-joins, never an OR."""
    a = right.select(F.col(first[1]).alias("__a"), F.col(value).alias("__va")).where("__a is not null")
    b = right.select(F.col(second[1]).alias("__b"), F.col(value).alias("__vb")).where("__b is not null")
    a, b = a.groupBy("__a").agg(F.max("__va").alias("__va")), b.groupBy("__b").agg(F.max("__vb").alias("__vb"))
    out = left.join(a, F.col(first[0]) == F.col("__a"), "left").join(b, F.col(second[0]) == F.col("__b"), "left")
    return out.withColumn(value, F.coalesce("__va", "__vb")).drop("__a", "__b", "__va", "__vb")


def coalesced(primary: DataFrame, other: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer join in which each field of the primary side wins unless null."""
    a = primary.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields))
    return a.join(other.select(*keys, *fields), keys, "full_outer").select(*keys, *(F.coalesce(f"__{f}", f).alias(f) for f in fields))


def flagged(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Whether the right side has a row."""
    return left.join(right.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Union in which the first frame that has a key supplies its row."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("__from", F.lit(k))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "__from")]
    return out.groupBy(key).agg(F.min_by(F.struct(*rest), "__from").alias("__r")).select(key, "__r.*")


def feed(legacy: DataFrame, cloud: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """Both feeds cut to ``limit`` each, cloud rows win, then sorted and cut again."""
    a, b = legacy.orderBy(*order).limit(limit), cloud.orderBy(*order).limit(limit)
    return b.unionByName(a.join(b.select(key), key, "left_anti").select(*b.columns)).orderBy(*order).limit(limit)
