"""The catalogue of sessions and replays: which are shown, how they are found, ordered and counted.

``rows`` has a row per session (session, slug, project, provider, title, first_prompt, prompt_count, model, git_branch,
modified); replays have (slug, session, title, scenes, prompt_count). ``today`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions import text
from tracewell.operators import joins, windows

QUOTA = 20 * 1024 * 1024
#: Days after which a provider cleans logs up, and how many days before that a session counts as expiring.
CLEANUP_DAYS, WARNING_DAYS = 30, 7
#: Branches that every repository has.
DEFAULT_BRANCHES = ("main", "master")
ENRICHED = 30
#: What each choice of order sorts by, largest first.
ORDERS = {"lastActivity": "last_activity", "sessions": "sessions", "cost": "cost", "duration": "duration_ms", "recent": "created_at", "popular": "view_count"}


def all_providers(frames: list[DataFrame]) -> DataFrame:
    """Sessions of all providers; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def kept(rows: DataFrame) -> DataFrame:
    """Sessions with an id and a prompt that still has 10 characters when it is cleaned (F8)."""
    prompt = F.exists("prompts", lambda p: F.length(text.clean_prompt(p)) >= 10)
    return rows.where(F.col("session").isNotNull() & (F.col("session") != "") & F.coalesce(prompt, F.lit(False)))


def previews(prompts: DataFrame, least: int = 8, limit: int = 200, n: int = 3) -> DataFrame:
    """(session, previews): the first ``n`` distinct cleaned prompts of ``least`` characters or more, cut."""
    short = prompts.select("session", "ord", F.substring(text.clean_prompt(F.col("text")), 1, limit).alias("p")).where(F.length("p") >= least)
    first = short.groupBy("session", "p").agg(F.min("ord").alias("ord"))
    top = windows.top_k(first, ["session"], ["ord"], n)
    return top.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "p"))), lambda x: x["p"]).alias("previews"))


def contains_any(query: str, *columns: str) -> Column:
    """Whether one of the columns holds the query, in any case."""
    low, out = query.lower(), F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(low), F.lit(False))
    return out


def find_sessions(rows: DataFrame, query: str = "", project: str | None = None) -> DataFrame:
    """Sessions of a project whose title, first prompt, slug or branch holds the query."""
    some = rows if project is None else rows.where(F.col("project") == project)
    return some.where(contains_any(query, "title", "first_prompt", "slug", "git_branch")) if query else some


def newest_first(rows: DataFrame) -> DataFrame:
    """(T2)"""
    return rows.orderBy(F.desc("modified"), "session")


def ordered(rows: DataFrame, by: str, key: str) -> DataFrame:
    """Rows by one of ORDERS, largest first, ties by key."""
    return rows.orderBy(F.desc_nulls_last(ORDERS[by]), key)


def grouped(rows: DataFrame) -> DataFrame:
    """(project, sessions, newest): projects by their newest session."""
    return rows.groupBy("project").agg(F.count("*").alias("sessions"), F.max("modified").alias("newest")).orderBy(F.desc("newest"), "project")


def choices(rows: DataFrame) -> DataFrame:
    """Sessions by project, the project with the newest session first, and newest first within it."""
    newest = F.max("modified").over(W.partitionBy("project"))
    return rows.withColumn("__newest", newest).orderBy(F.desc("__newest"), "project", F.desc("modified"), "session").drop("__newest")


def is_noise(shown: Column) -> Column:
    """A text of which cleaning leaves nothing."""
    return F.coalesce((text.strip(shown) != "") & (text.clean_prompt(shown) == ""), F.lit(False))


def to_enrich(rows: DataFrame, known: DataFrame, provider: str = "cursor", limit: int = ENRICHED) -> DataFrame:
    """The newest ``known`` sessions among those of ``rows`` that lack something.

    A row of the provider lacks something if it has no count of prompts or of tool calls, no title or no model, or its title
    or first prompt is noise, and if there is a file or store to read it from (``readable``). It stands for the known session
    of its id, else for that of its provider, project and slug; rows without one are left out.
    """
    empty = lambda c: F.coalesce(text.strip(F.col(c)), F.lit("")) == ""
    lacking = F.col("prompt_count").isNull() | F.col("tool_call_count").isNull() | empty("title") | (F.coalesce("model", F.lit("")) == "") | is_noise(F.col("title")) | is_noise(F.col("first_prompt"))
    some = rows.where((F.col("provider") == provider) & lacking & F.coalesce("readable", F.lit(False))).select("session", "provider", "project", "slug", F.monotonically_increasing_id().alias("__row"))
    columns = known.columns
    whole = F.struct(*columns)
    by_id = some.join(known.select("session", whole.alias("__known")), "session")
    rest = some.join(by_id.select("__row"), "__row", "left_anti")
    key = ["provider", "project", "slug"]
    by_key = rest.join(known.select(*key, whole.alias("__known")), key)
    found = by_id.select("__row", "__known").union(by_key.select("__row", "__known"))
    return newest_first(found.select("__known.*")).limit(limit)


def visible(rows: DataFrame, user: str | None, now: str) -> DataFrame:
    """Rows that a user may open: one's own, or those that aren't private and haven't expired (F16)."""
    open_ = (F.col("visibility") != "private") & (F.col("expires_at").isNull() | (F.col("expires_at").cast("timestamp") > F.lit(now).cast("timestamp")))
    return rows.where((F.col("owner") == user) | open_ if user is not None else open_)


def storage(rows: DataFrame) -> DataFrame:
    """(owner, bytes)."""
    return rows.groupBy("owner").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def within_quota(rows: DataFrame, added: int, quota: int = QUOTA) -> DataFrame:
    """Owners who may add so many bytes."""
    return storage(rows).where(F.col("bytes") + added <= quota)


def days_left(at: Column, now: str, period: float = CLEANUP_DAYS) -> Column:
    """Whole days until a log is cleaned up, 0 at least; null for a period of 0 or less, and for what is no time."""
    time = F.try_to_timestamp(at.cast("string"))
    age = (F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(time)) / F.lit(86_400_000.0)
    return F.when(F.lit(period) > 0, F.greatest(F.lit(0).cast("long"), F.floor(F.lit(float(period)) - age)) + F.when(age.isNotNull(), 0))


def expiring(rows: DataFrame, provider: str, now: str, period: float = CLEANUP_DAYS, within: int = WARNING_DAYS) -> DataFrame:
    """(expiring, soonest) of a provider's sessions that go within so many days."""
    left = days_left(F.col("modified"), now, period)
    return rows.where((F.col("provider") == provider) & (left <= within)).agg(F.count("*").alias("expiring"), F.min(left).alias("soonest"))


def shown(scenes: DataFrame, prompts_only: bool = False, hide_thinking: bool = False) -> DataFrame:
    """Scenes of a display mode."""
    out = scenes.where(F.col("type") == "user-prompt") if prompts_only else scenes
    return out.where(F.col("type") != "thinking") if hide_thinking else out


def own_branch() -> Column:
    """Whether a session ran on a branch that not every repository has."""
    return F.coalesce(F.col("git_branch").isNotNull() & ~F.col("git_branch").isin(*DEFAULT_BRANCHES, ""), F.lit(False))


def project_counts(rows: DataFrame, replays: DataFrame) -> DataFrame:
    """(project, sessions, replays): a replay counts for its session's project."""
    of = rows.join(replays.select("slug").distinct().withColumn("__r", F.lit(1)), "slug", "left")
    return of.groupBy("project").agg(F.count("*").alias("sessions"), F.count("__r").alias("replays"))


def with_scan(rows: DataFrame, scans: DataFrame) -> DataFrame:
    """Sessions with the last scan result of their slug: (slug, at, prompt_count, tool_calls)."""
    last = joins.last_per_key(scans.select("slug", "at", F.col("prompt_count").alias("scanned_prompts"), "tool_calls"), ["slug"], ["at"]).drop("at")
    return rows.join(last, "slug", "left")


def home(rows: DataFrame, replays: DataFrame) -> DataFrame:
    """One row: sessions, projects, providers, prompts, replays and their share; of a session and its replay the larger count of prompts counts."""
    both = rows.select("slug", "project", "provider", F.col("prompt_count").alias("a")).join(replays.groupBy("slug").agg(F.max("prompt_count").alias("b")), "slug", "full_outer")
    prompts = F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))
    sessions, with_replay = F.count_if(F.col("a").isNotNull()), F.count_if(F.col("b").isNotNull())
    return both.agg(
        sessions.alias("sessions"), F.count_distinct("project").alias("projects"), F.count_distinct("provider").alias("providers"), F.sum(prompts).alias("prompts"), with_replay.alias("replays"),
        F.round(F.try_divide(100.0 * F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), sessions)).alias("converted_percent"),
    )


def days(rows: DataFrame) -> DataFrame:
    """One row: the busiest day, the first of several, active days, sessions a day and prompts a session."""
    each = rows.groupBy(F.to_date("modified").alias("day")).agg(F.count("*").alias("n"), F.sum("prompt_count").alias("prompts")).where("day is not null")
    return each.agg(
        F.max_by("day", F.struct("n", -F.datediff("day", F.lit("1970-01-01")))).alias("peak_day"), F.max("n").alias("peak"), F.count("*").alias("active_days"),
        F.round(F.avg("n"), 6).alias("per_day"), F.round(F.try_divide(F.sum("prompts").cast("double"), F.sum("n")), 6).alias("prompts_per_session"),
    )


def with_notes(projects: DataFrame, notes: DataFrame) -> DataFrame:
    """Projects with how many memory notes they have."""
    n = notes.groupBy("project").agg(F.count("*").alias("notes"))
    return projects.join(n, "project", "left").withColumn("notes", F.coalesce("notes", F.lit(0)))


def outline_position(outline: DataFrame, positions: DataFrame) -> DataFrame:
    """(session, position, turn): the turn of the outline (session, turn, first_index) that a position lies in."""
    rows = outline.select("session", F.col("first_index").alias("at"), "turn", F.lit(0).alias("side")).unionByName(positions.select("session", F.col("position").alias("at"), F.lit(None).cast("long").alias("turn"), F.lit(1).alias("side")))
    w = W.partitionBy("session").orderBy("at", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("turn", F.last("turn", ignorenulls=True).over(w)).where("side = 1").select("session", F.col("at").alias("position"), "turn")


def safe_slug(column: Column) -> Column:
    """Whether a slug may be part of a path."""
    return F.coalesce(column.rlike(r"^[A-Za-z0-9._-]+$") & ~column.contains("..") & ~column.startswith("."), F.lit(False))


def tool_action(tool: Column) -> Column:
    """What a tool call does: read, edit, create, run or search; null for tools that say nothing of the work."""
    return F.when(tool.isin("Read", "View"), "read").when(tool == "Edit", "edit").when(tool == "Write", "create").when(tool == "Bash", "run").when(tool.isin("Glob", "Grep"), "search")


def run_passed(tool: Column, result: Column) -> Column:
    """Whether a command passed or failed, as its result tells; null where it doesn't, and for other tools."""
    low = F.lower(F.coalesce(result, F.lit("")))
    any_of = lambda *words: low.rlike("|".join(words))
    return F.when(tool == "Bash", F.when(any_of("error", "failed", "fail ", "exit code"), False).when(any_of("passed", "success", "all tests"), True))


#: The largest counts and the longest texts that a published document's row may have.
MOST = {"scene_count": 100_000, "user_prompts": 10_000, "tool_calls": 100_000, "duration_ms": 86_400_000}
LONGEST = {"title": 200, "provider": 50, "model": 100, "first_message": 300}
_STATS = {"scene_count": "sceneCount", "user_prompts": "userPrompts", "tool_calls": "toolCalls", "duration_ms": "durationMs"}


def upload_error(document: Column) -> Column:
    """What a published document lacks, else null: a meta object with session id and provider, and scenes with types."""
    whole = F.try_parse_json(document)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(whole, path, "variant"))
    filled = lambda path: F.coalesce((kind(path) == "STRING") & (F.try_variant_get(whole, path, "string") != ""), F.lit(False))
    out = F.when(~F.coalesce(kind("$.meta").startswith("OBJECT"), F.lit(False)), "Missing meta object").when(~filled("$.meta.sessionId"), "Missing meta.sessionId").when(~filled("$.meta.provider"), "Missing meta.provider")
    out = out.when(~F.coalesce(kind("$.scenes").startswith("ARRAY"), F.lit(False)), "Missing scenes array")
    scenes = F.try_variant_get(whole, "$.scenes", "array<variant>")
    for i in range(5):
        there = F.size(scenes) > i
        out = out.when(there & ~F.coalesce(kind(f"$.scenes[{i}].type") == "STRING", F.lit(False)), f"Invalid scene at index {i}: missing type")
    return out


def upload_row(document: Column) -> Column:
    """(title, provider, model, counts, cost_estimate, first_message) of a published document, clamped and cut."""
    get = lambda path: F.nullif(F.get_json_object(document, path), F.lit(""))
    number = lambda path: F.coalesce(F.get_json_object(document, path).try_cast("double"), F.lit(0.0))
    clamped = lambda x, most: F.greatest(F.lit(0.0), F.least(x, F.lit(float(most))))
    has_meta = get("$.meta").startswith("{")
    text_of = lambda name, value: F.substring(value, 1, LONGEST[name]).alias(name)
    cost = clamped(number("$.meta.stats.costEstimate"), 100_000)
    scenes = F.from_json(F.get_json_object(document, "$.scenes"), "array<struct<type:string,content:string>>")
    first = F.try_element_at(F.filter(scenes, lambda s: s["type"] == "user-prompt"), F.lit(1))["content"]
    return F.struct(
        text_of("title", F.coalesce(get("$.meta.title"), get("$.meta.project"), F.lit("Untitled"))),
        text_of("provider", F.when(has_meta, F.coalesce(get("$.meta.provider"), F.lit("unknown"))).otherwise("claude-code")),
        text_of("model", get("$.meta.model")),
        *(clamped(number(f"$.meta.stats.{_STATS[k]}"), most).cast("long").alias(k) for k, most in MOST.items()),
        F.when(get("$.meta.stats.costEstimate").isNotNull(), F.when(cost == F.floor(cost), cost.cast("long").cast("string")).otherwise(cost.cast("string"))).alias("cost_estimate"),
        text_of("first_message", F.nullif(first, F.lit(""))),
    )
