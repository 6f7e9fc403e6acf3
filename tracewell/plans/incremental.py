"""Keeping tables up to date: only changed sessions are read again, rows are merged, expired ones go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import joins


def fingerprints(files: DataFrame, session: Column, version: str) -> DataFrame:
    """(session, fingerprint, newest): of the newest time and the total size of a session's files, and the scanner's version."""
    each = files.groupBy(session.alias("session")).agg(F.max("modified").alias("newest"), F.sum("length").alias("size"))
    return each.select("session", F.sha2(F.concat_ws("|", F.unix_micros(F.col("newest").cast("timestamp")).cast("string"), F.col("size").cast("string"), F.lit(version)), 256).alias("fingerprint"), "newest")


def changed(now: DataFrame, known: DataFrame) -> DataFrame:
    """Sessions that are new or whose fingerprint isn't the stored one."""
    return now.join(known.select("session", "fingerprint"), ["session", "fingerprint"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without a new one of their key, and all new rows; a null key is a key like others."""
    named = new.select(*(F.col(k).alias(f"__new_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"__new_{k}")) for k in keys]
    return old.join(named, same, "left_anti").unionByName(new, allowMissingColumns=True)


def counters(totals: DataFrame, views: DataFrame, key: str) -> DataFrame:
    """Stored counts plus the events since."""
    added = views.groupBy(key).agg(F.count("*").alias("__n"), F.max("viewed_at").alias("__at"))
    out = totals.join(added, key, "left")
    return out.withColumn("view_count", F.col("view_count") + F.coalesce("__n", F.lit(0))).withColumn("last_viewed_at", F.greatest("last_viewed_at", "__at")).drop("__n", "__at")


def current(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last entry of each key of an append-only log, unless it deletes."""
    return joins.last_per_key(log, keys, [at]).where("not coalesce(deleted, false)").drop("deleted")


def overlaid(scenes: DataFrame, overlays: DataFrame) -> DataFrame:
    """Scenes whose content gives way to that of the overlay (session, scene_index, modified), where there is one."""
    kinds = F.col("type").isin("user-prompt", "text-response", "thinking", "compaction-summary")
    out = scenes.join(overlays.select("session", "scene_index", "modified"), ["session", "scene_index"], "left")
    return out.withColumn("content", F.when(kinds, F.coalesce("modified", "content")).otherwise(F.col("content"))).drop("modified")


def annotated(scenes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Adds ``annotations``, how many a scene has."""
    n = annotations.groupBy("session", "scene_index").agg(F.count("*").alias("annotations"))
    return scenes.join(n, ["session", "scene_index"], "left").withColumn("annotations", F.coalesce("annotations", F.lit(0)))


def unexpired(rows: DataFrame, now: str, grace_days: int = 7) -> DataFrame:
    """Rows that haven't expired more than ``grace_days`` ago."""
    limit = F.lit(now).cast("timestamp") - F.expr(f"interval {int(grace_days)} days")
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at").cast("timestamp") >= limit))


def swept(rows: DataFrame, now: str, grace_days: int = 7) -> DataFrame:
    """All rows, with size 0 where they expired more than ``grace_days`` ago, so that they use up no quota."""
    limit = F.lit(now).cast("timestamp") - F.expr(f"interval {int(grace_days)} days")
    gone = F.coalesce(F.col("expires_at").cast("timestamp") < limit, F.lit(False))
    return rows.withColumn("size", F.when(gone, F.lit(0)).otherwise(F.col("size")).cast(rows.schema["size"].dataType))


def public(rows: DataFrame, now: str) -> DataFrame:
    """(F15)"""
    return rows.where((F.col("visibility") == "public") & (F.col("expires_at").isNull() | (F.col("expires_at").cast("timestamp") > F.lit(now).cast("timestamp"))))
