"""Order-dependent operators: gaps, turns, islands, streaks, snapshots, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_GAP_MS = 300_000


def millis(ts: str) -> Column:
    """Epoch milliseconds of a timestamp with or without zone."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def capped_gap(key: str, ts: str, max_gap_ms: int = MAX_GAP_MS) -> Column:
    """Milliseconds since the time before of the same key, capped; null at the first time and where there is none."""
    gap = millis(ts) - F.lag(millis(ts)).over(W.partitionBy(key).orderBy(ts))
    return F.when(gap.isNotNull(), F.least(gap, F.lit(max_gap_ms)))  # least() would skip the first row's null


def active_duration(df: DataFrame, key: str, ts: str, max_gap_ms: int = MAX_GAP_MS) -> DataFrame:
    """(key, active_ms): gaps between successive times, each capped; null with fewer than two times or no gap."""
    gaps = df.where(F.col(ts).isNotNull()).select(key, capped_gap(key, ts, max_gap_ms).alias("gap"))
    return gaps.groupBy(key).agg(F.nullif(F.sum("gap"), F.lit(0)).alias("active_ms"))


def turn_id(boundary: Column, keys: list[str], order: list[str]) -> Column:
    """How many boundary rows came so far; 0 before the first."""
    return F.sum(F.when(boundary, 1).otherwise(0)).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))


def consecutive_dedup(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the last row before; null and empty values are left out first."""
    known = df.where(F.col(value).isNotNull() & (F.col(value) != ""))
    last = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    return known.withColumn("__last", last).where(~F.col("__last").eqNullSafe(F.col(value))).drop("__last")


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``island``: the number of the run of equal values."""
    w = W.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__change", change).withColumn("island", F.sum("__change").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__change")


def streaks(days: DataFrame, key: str, day: str, today: str) -> DataFrame:
    """(key, longest, longest_start, current): runs of successive days; the current one ends today or yesterday."""
    own = days.select(key, F.col(day).cast("date").alias("d")).distinct()
    runs = own.withColumn("g", F.date_sub("d", F.row_number().over(W.partitionBy(key).orderBy("d")))).groupBy(key, "g")
    runs = runs.agg(F.count("*").alias("n"), F.min("d").alias("start"), F.max("d").alias("end"))
    best = F.max_by(F.struct("n", "start"), F.struct(F.col("n"), -F.datediff("start", F.lit("1970-01-01"))))
    now = F.max(F.when(F.col("end") >= F.date_sub(F.lit(today).cast("date"), 1), F.col("n")))
    return runs.groupBy(key).agg(best.alias("best"), F.coalesce(now, F.lit(0)).alias("current")).select(key, F.col("best.n").alias("longest"), F.col("best.start").alias("longest_start"), "current")


def snapshot_delta(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Sums of increments of cumulative snapshots; a drop in any field means a reset, after which the whole snapshot counts."""
    some = df.where(" or ".join(f"coalesce({f}, 0) <> 0" for f in fields))
    w = W.partitionBy(*keys).orderBy(*order)
    for f in fields:
        some = some.withColumn(f"__{f}", F.lag(f).over(w))
    reset = F.lit(False)
    for f in fields:
        reset = reset | F.col(f"__{f}").isNull() | (F.col(f) < F.col(f"__{f}"))
    step = [F.sum(F.when(reset, F.col(f)).otherwise(F.greatest(F.lit(0), F.col(f) - F.col(f"__{f}")))).alias(f) for f in fields]
    return some.groupBy(*keys).agg(*step)


def idle_gaps(df: DataFrame, keys: list[str], order: list[str], ts: str, at: Column, least_ms: int = 120_000) -> DataFrame:
    """Rows that satisfy ``at`` and come more than ``least_ms`` after the last known time, with ``gap_ms``."""
    before = F.last(millis(ts), ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("gap_ms", millis(ts) - before).where(at & (F.col("gap_ms") > least_ms))


def context_drops(df: DataFrame, keys: list[str], order: list[str], context: str, share: float = 0.5) -> DataFrame:
    """Rows after which the context falls below ``share`` of its size, both above zero."""
    after = F.lead(context).over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("next_context", after).where((F.col(context) > 0) & (F.col("next_context") > 0) & (F.col("next_context") < share * F.col(context)))


def last_result_start(result_ts: Column, own_ts: Column, keys: list[str], order: list[str]) -> Column:
    """When a tool call began: at the result before it in its message, else with the message."""
    return F.coalesce(F.last(result_ts, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), own_ts)


def neighbours(df: DataFrame, keys: list[str], index: str, mask: Column) -> DataFrame:
    """Adds ``prev_index`` and ``next_index``: the nearest masked rows before and after each row."""
    masked = F.when(mask, F.col(index))
    so_far = lambda order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before, after = F.max(masked).over(so_far(F.asc(index))), F.min(masked).over(so_far(F.desc(index)))  # frames that only grow
    return df.withColumn("prev_index", before).withColumn("next_index", after)


def phases(df: DataFrame, keys: list[str], order: list[str], prompt: Column, system: Column) -> DataFrame:
    """Adds ``phase``: prompts that aren't the system's begin one; rows before the first are left out."""
    return df.withColumn("phase", turn_id(prompt & ~system, keys, order)).where("phase >= 1")


def actions(df: DataFrame, keys: list[str], order: list[str], kind: str, file: str) -> DataFrame:
    """Reads in a row become one action with their files, searches after a search are dropped, others stay.

    Reads without a file emit nothing and don't break a run, so they go first.
    """
    some = df.where((F.col(kind) != "read") | F.col(file).isNotNull())
    runs = islands(some, keys, order, kind)
    first = F.struct(*order)
    grouped = runs.where(F.col(kind).isin("read", "search")).groupBy(*keys, "island", kind).agg(F.min(first).alias("at"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(first.alias("o"), F.col(file).alias("f")))), lambda x: x["f"])).alias("files"))
    single = runs.where(~F.col(kind).isin("read", "search")).select(*keys, "island", kind, first.alias("at"), F.array(F.col(file)).alias("files"))
    return grouped.unionByName(single)


def cumulative(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Running sum."""
    return df.withColumn(name, F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def ratio_to_max(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Share of the group's largest value, which counts as 1 at least."""
    return df.withColumn(name, F.col(value) / F.greatest(F.max(value).over(W.partitionBy(*keys)), F.lit(1)))


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps k rows a group before the shuffle."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= k)
