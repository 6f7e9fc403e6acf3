"""Aggregates over session rows: projects, users, branches, files, days, models. ``today`` is always a parameter.

``rows`` has a row per session as ``sessions.scan`` gives it, with ``project`` and ``provider`` added from a catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.operators import joins, windows

TOKENS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")


def day() -> Column:
    """Days are the first ten characters of the start, in UTC."""
    return F.to_date(F.substring("start_time", 1, 10))


def _totals() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    timed = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    return [
        F.count("*").alias("sessions"),
        *(total(c) for c in ("prompt_count", "tool_call_count", "edit_count", "sub_agent_count", "api_error_count", "compaction_count", *TOKENS)),
        F.coalesce(F.sum(timed), F.lit(0)).alias("duration_ms"),
        F.floor(F.avg(timed) + 0.5).alias("avg_duration_ms"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.min("start_time").alias("first_activity"),
        F.max(F.coalesce("end_time", "start_time")).alias("last_activity"),
        F.count_distinct(day()).alias("active_days"),
    ]


def rolled_up(rows: DataFrame) -> DataFrame:
    """A row for each project and one for all sessions (``every`` is true, project null), from one pass.

    Totals, the average over sessions that have a duration, the number of projects, distinct branches (for all sessions:
    of each project) and distinct links. Every session gives a row for its totals and one for each of its branches and links, which one
    expansion counts for its project and for all.
    """
    none = F.lit(None).cast("string")
    branch = F.transform(F.coalesce(_branches(), F.array().cast("array<string>")), lambda b: F.struct(F.lit(1).alias("kind"), b.alias("value")))
    link = F.transform(F.coalesce(F.transform("pr_links", lambda p: p["pr_url"]), F.array().cast("array<string>")), lambda u: F.struct(F.lit(2).alias("kind"), u.alias("value")))
    self_ = F.array(F.struct(F.lit(0).alias("kind"), none.alias("value")))
    each = rows.withColumn("__of", F.explode(F.concat(self_, branch, link))).withColumn("__kind", F.col("__of.kind")).withColumn("__value", F.col("__of.value"))
    own = F.col("__kind") == 0
    kept = [c for c in rows.columns if c not in ("project", "git_branch", "git_branches", "pr_links")]
    each = each.select("project", "__kind", "__value", *(F.when(own, F.col(c)).alias(c) for c in kept))
    of = lambda k, *c: F.count_distinct(*(F.when(F.col("__kind") == k, F.col(x)) for x in c))
    totals = [F.count_if(own).alias("sessions"), *_totals()[1:]]
    sets = each.groupingSets([["project"], []], "project")
    out = sets.agg(
        (F.grouping("project") == 1).alias("every"), *totals,
        F.count_distinct(F.when(own, F.col("project"))).alias("projects"), of(1, "project", "__value").alias("branches_of_projects"), of(1, "__value").alias("branches"), of(2, "__value").alias("pull_requests"),
    )
    return out.withColumn("branches", F.when(F.col("every"), F.col("branches_of_projects")).otherwise(F.col("branches"))).drop("branches_of_projects")


def projects(rows: DataFrame) -> DataFrame:
    """One row per project: totals, the average over sessions that have a duration, distinct branches and links."""
    return rolled_up(rows).where("not every").drop("every", "projects")


def user(rows: DataFrame) -> DataFrame:
    """One row for all sessions, with distinct projects, branches of a project and links."""
    return rolled_up(rows).where("every").drop("every", "project")


def _branches() -> Column:
    return F.coalesce("git_branches", F.when(F.col("git_branch").isNotNull(), F.array("git_branch")))


def branches(rows: DataFrame) -> DataFrame:
    """(project, branch, sessions, pull_requests): a session counts for each of its branches, its links for the last one."""
    of = rows.select("project", "session", F.explode(F.array_distinct(_branches())).alias("branch")).groupBy("project", "branch").agg(F.count_distinct("session").alias("sessions"))
    links = rows.select("project", F.col("git_branch").alias("branch"), F.explode("pr_links").alias("p")).groupBy("project", "branch").agg(F.count_distinct("p.pr_url").alias("pull_requests"))
    return of.join(links, ["project", "branch"], "left").withColumn("pull_requests", F.coalesce("pull_requests", F.lit(0)))


#: Tasks that get the sessions of one file, or the files of one project, at most.
SHARES = 16


def hot_files(rows: DataFrame, limit: int = 20, parts: int | None = None) -> DataFrame:
    """(project, file, edits, sessions, rn): most edited first.

    With ``parts``, entries are dealt to that many tasks, so that a task's memory doesn't grow with the rows. Then a file's sessions are
    first counted in shares, and a project's files first ranked in shares: neither fills one task.
    """
    each = rows.select("project", "session", F.explode("files_modified").alias("f")).select("project", "session", "f.file", "f.count")
    edits, order = F.sum("count").alias("edits"), [F.desc("edits"), "file"]
    if parts is None:
        return windows.top_k(each.groupBy("project", "file").agg(edits, F.count_distinct("session").alias("sessions")), ["project"], order, limit)
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARES))
    counted = each.withColumn("share", share("session")).repartition(parts, "project", "file", "share").groupBy("project", "file", "share").agg(edits, F.count_distinct("session").alias("sessions"))
    whole = counted.withColumn("share", share("file")).repartition(parts, "project", "share").groupBy("project", "share", "file").agg(F.sum("edits").alias("edits"), F.sum("sessions").alias("sessions"))
    some = windows.top_k(whole, ["project", "share"], order, limit).drop("share", "rn")
    return windows.top_k(some.repartition(parts, "project"), ["project"], order, limit)


def per_day(rows: DataFrame) -> DataFrame:
    return rows.where(day().isNotNull()).groupBy(day().alias("day")).agg(F.count("*").alias("sessions"), F.sum("prompt_count").alias("prompts"), F.sum("cost").alias("cost"))


def spine(rows: DataFrame, today: str, days: int, step: int = 1) -> DataFrame:
    """``days`` dates up to ``today``, ``step`` days apart."""
    return rows.sparkSession.range(days).select(F.date_sub(F.lit(today).cast("date"), (F.col("id") * step).cast("int")).alias("day"))


def heatmap(rows: DataFrame, today: str, weeks: int = 52) -> DataFrame:
    """(day, sessions, level): every day of the last weeks up to the Saturday of this one, levels 0 to 4 by quarters of the busiest."""
    end = F.date_add(F.lit(today).cast("date"), 7 - F.dayofweek(F.lit(today).cast("date")))
    grid = rows.sparkSession.range(7 * weeks).select(F.date_sub(end, F.col("id").cast("int")).alias("day"))
    grid = grid.join(per_day(rows).select("day", "sessions"), "day", "left").select("day", F.coalesce("sessions", F.lit(0)).alias("sessions"))
    top = F.max("sessions").over(W.partitionBy(F.lit(1)))  # as many rows as days
    return grid.withColumn("level", F.when(F.col("sessions") == 0, 0).otherwise(F.least(F.lit(4), F.ceil(4.0 * F.col("sessions") / F.greatest(top, F.lit(1))))).cast("int"))


def weekdays(rows: DataFrame) -> DataFrame:
    """(dow, sessions), Sunday 0 to Saturday 6, zeros included."""
    days = rows.sparkSession.range(7).select(F.col("id").cast("int").alias("dow"))
    counts = rows.where(day().isNotNull()).groupBy((F.dayofweek(day()) - 1).alias("dow")).agg(F.count("*").alias("sessions"))
    return days.join(counts, "dow", "left").select("dow", F.coalesce("sessions", F.lit(0)).alias("sessions"))


def weeks(rows: DataFrame, today: str, n: int = 12) -> DataFrame:
    """(week, sessions): the last ``n`` weeks from Monday on, zeros included."""
    last = F.to_date(F.date_trunc("week", F.lit(today).cast("date")))
    grid = rows.sparkSession.range(n).select(F.date_sub(last, (7 * F.col("id")).cast("int")).alias("week"))
    counts = rows.groupBy(F.to_date(F.date_trunc("week", day())).alias("week")).agg(F.count("*").alias("sessions"))
    return grid.join(counts, "week", "left").select("week", F.coalesce("sessions", F.lit(0)).alias("sessions"))


def trend(rows: DataFrame, today: str, weeks_each: int = 4) -> DataFrame:
    """(recent, prior, change): weekly averages of the last weeks and of those before; change is null without prior ones."""
    grid = weeks(rows, today, 2 * weeks_each).withColumn("recent", F.col("week") > F.date_sub(F.to_date(F.date_trunc("week", F.lit(today).cast("date"))), 7 * weeks_each))
    sums = grid.agg((F.sum(F.when(F.col("recent"), F.col("sessions")).otherwise(0)) / weeks_each).alias("recent"), (F.sum(F.when(~F.col("recent"), F.col("sessions")).otherwise(0)) / weeks_each).alias("prior"))
    return sums.withColumn("change", F.try_divide(F.col("recent") - F.col("prior"), F.col("prior")))


def streak(rows: DataFrame, today: str, key: str = "provider") -> DataFrame:
    return windows.streaks(rows.where(day().isNotNull()).select(key, day().alias("day")), key, "day", today)


def in_range(rows: DataFrame, today: str, days: int | None) -> DataFrame:
    """Sessions of the last ``days`` days, all for none."""
    return rows if days is None else rows.where(day() >= F.date_sub(F.lit(today).cast("date"), days))


def scaled(rows: DataFrame, today: str, days: int) -> DataFrame:
    """Sessions of the range, and totals scaled by their share of all sessions."""
    inside = F.count_if(day() >= F.date_sub(F.lit(today).cast("date"), days))
    share = F.try_divide(inside.cast("double"), F.count("*"))
    return rows.agg(inside.alias("sessions"), *((F.coalesce(F.sum(c), F.lit(0)) * share).alias(c) for c in ("prompt_count", "tool_call_count", "edit_count", "cost")))


def shares(rows: DataFrame, key: str) -> DataFrame:
    """(key, sessions, share) of models or providers."""
    counts = rows.groupBy(key).agg(F.count("*").alias("sessions"))
    total = counts.agg(F.sum("sessions").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "sessions", (F.col("sessions") / F.col("total")).alias("share"))  # one row on the right


def with_quality(rows: DataFrame, provider: str = "cursor") -> DataFrame:
    """Adds ``notes`` on what a session's measures are worth, and for duration, tokens and turn_stats the first note that is about them.

    ``rows`` has provider, data_source, source_notes (an array or null) and the token counts.
    """
    guessed = F.when((F.col("provider") == provider) & F.col("data_source").isin("sqlite", "global-state"), F.lit("Some Cursor metrics are best-effort estimates and may be incomplete."))
    partial = F.when(F.col("input_tokens").isNull(), F.lit("Token and cost metrics may be unavailable."))
    own = F.coalesce("source_notes", F.array().cast("array<string>"))
    out = rows.withColumn("notes", F.array_distinct(F.array_compact(F.concat(F.array(guessed), own, F.array(partial)))))
    about = {"duration": "(?i)duration", "tokens": "(?i)token|cost|model attribution", "turn_stats": "(?i)per-turn|turn stats|turn metrics"}
    first = lambda pattern: F.try_element_at(F.filter("notes", lambda n: n.rlike(pattern)), F.lit(1))
    return out.withColumns({f"{k}_note": first(pattern) for k, pattern in about.items()})


def quality(rows: DataFrame, provider: str = "cursor") -> DataFrame:
    """One row (total, estimated, no_duration, no_tokens, no_turn_stats, notes) for the sessions of the second provider; none without one.

    ``rows`` has provider, source_notes, duration_ms, the token counts and turn_count.
    """
    about = F.exists(F.coalesce("source_notes", F.array().cast("array<string>")), lambda n: n.rlike(r"(?i)duration.*estimated|estimated.*duration"))
    lacks = lambda c: F.count_if(F.coalesce(c, F.lit(0)) == 0)
    n = rows.where(F.col("provider") == provider).agg(F.count("*").alias("total"), F.count_if(about).alias("estimated"), lacks("duration_ms").alias("no_duration"), F.count_if(F.col("input_tokens").isNull()).alias("no_tokens"), lacks("turn_count").alias("no_turn_stats"))
    said = {
        "estimated": "use best-effort duration estimates.", "no_duration": "do not have enough timing data to compute duration.",
        "no_tokens": "do not include token snapshots, so token and cost totals are partial.", "no_turn_stats": "do not include per-turn stats.",
    }
    notes = [F.when(F.col(k) > 0, F.format_string(f"%d/%d Cursor sessions {v}", k, "total")) for k, v in said.items()]
    return n.where("total > 0").withColumn("notes", F.array_compact(F.array(*notes)))


def latest_of_parts(catalogue: DataFrame) -> DataFrame:
    """Parts of one session (project, slug) as one row: the latest part's fields, sums of sizes, its files in order."""
    rest = [c for c in catalogue.columns if c not in ("project", "slug", "size", "path", "prompts", "tool_calls")]
    one = catalogue.groupBy("project", "slug").agg(
        F.max_by(F.struct(*rest), F.struct("modified", "path")).alias("r"), F.sum("size").alias("size"), F.sum("prompts").alias("prompts"), F.sum("tool_calls").alias("tool_calls"),
        F.transform(F.array_sort(F.collect_list(F.struct("modified", "path"))), lambda x: x["path"]).alias("paths"),
    )
    return one.select("project", "slug", "r.*", "size", "prompts", "tool_calls", "paths")


def sources(catalogue: DataFrame, replays: DataFrame, archived: DataFrame) -> DataFrame:
    """The catalogue with each session's replay, by slug and else by session, and whether it is archived."""
    matched = joins.preferred(catalogue, replays, ("slug", "slug"), ("session", "session"), "replay")
    return joins.flagged(matched, archived, ["slug"], "archived")
