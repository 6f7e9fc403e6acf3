"""Summaries of sessions as Markdown, and the hashes and checks that publishing needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import windows

#: The order in which a summary lists tools; others come after them by count.
TOOL_ORDER = ("Edit", "Write", "Bash", "Read", "Grep", "Glob", "Agent")
UPLOAD_LIMIT = 10 * 1024 * 1024
EDITS_AT_RISK = 4


def condense(column: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters."""
    one = text.strip(F.regexp_replace(column, r"\s+", " "))
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit - 1), F.lit("…"))).otherwise(one)


def escape(column: Column) -> Column:
    return F.regexp_replace(column, r"([\\`*_{}\[\]<>#|])", r"\\$1")


def phases(scenes: DataFrame) -> DataFrame:
    """Adds ``phase``: prompts that a person wrote begin one, earlier scenes are left out."""
    return windows.phases(scenes, ["session"], ["scene_index"], F.col("type") == "user-prompt", text.is_system_generated(F.coalesce("content", F.lit(""))))


def tool_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tool, n, commands): how often each tool ran, and the distinct first words of its commands in order."""
    used = rows.where("type = 'tool-call'").select(*keys, "scene_index", F.col("tool_name").alias("tool"), text.first_word(F.col("bash.command")).alias("word"))
    each = used.groupBy(*keys, "tool", "word").agg(F.count("*").alias("n"), F.min("scene_index").alias("first"))
    words = F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("first", "word")))), lambda x: x["word"])
    return each.groupBy(*keys, "tool").agg(F.sum("n").alias("n"), words.alias("commands"))


def breakdown(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line): tools in the fixed order with counts, the first four commands in brackets."""
    short = text.tool_short_name(F.col("tool"))
    words = F.when(F.size("commands") > 0, F.concat(F.lit(" ("), F.array_join(F.slice("commands", 1, 4), ", "), F.when(F.size("commands") > 4, ", ...").otherwise(""), F.lit(")"))).otherwise("")
    label = F.concat(F.col("n").cast("string"), F.lit(" "), short, words)
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in TOOL_ORDER)), F.col("tool")), F.lit(0)), F.lit(100))
    listed = F.array_sort(F.collect_list(F.struct(place.alias("place"), (-F.col("n")).alias("n"), F.col("tool").alias("tool"), label.alias("label"))))
    return tool_counts(rows, keys).groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["label"]), ", ").alias("line"))


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stats, prompt, preview): responses, tools and thinking in a line, the first prompt and the last response."""
    kind = lambda t: F.count_if(F.col("type") == t)
    said = (F.col("type") == "text-response") & (F.length(text.strip(F.col("content"))) > 10)
    n = rows.groupBy(*keys).agg(
        kind("text-response").alias("a"), kind("tool-call").alias("b"), kind("thinking").alias("c"),
        F.min_by("content", F.when(F.col("type") == "user-prompt", F.col("scene_index"))).alias("prompt"), F.max_by("content", F.when(said, F.col("scene_index"))).alias("preview"),
    )
    parts = [F.when(F.col(x) > 0, F.concat(F.col(x).cast("string"), F.lit(f" {name}"))) for x, name in (("a", "responses"), ("b", "tools"), ("c", "thinking"))]
    with_tools = n.join(breakdown(rows, keys), keys, "left")
    stats = F.concat(F.concat_ws(" · ", *parts), F.coalesce(F.concat(F.lit(" — "), F.col("line")), F.lit("")))
    return with_tools.select(*keys, stats.alias("stats"), "prompt", "preview")


def risks(scenes: DataFrame) -> DataFrame:
    """(session, risk): files changed four times or more, failed tests, whether others passed, and compaction."""
    path = F.col("diff.file_path")
    changed = scenes.where(F.col("tool_name").isin("Edit", "Write") & (path != "")).groupBy("session", text.last_two(path).alias("file")).agg(F.count("*").alias("n")).where(F.col("n") >= EDITS_AT_RISK)
    files = changed.select("session", F.format_string("`%s` modified %dx", "file", "n").alias("risk"))
    low, command = F.lower(F.coalesce("result", F.lit(""))), F.coalesce("bash.command", F.lit(""))
    ran = scenes.where((F.col("type") == "tool-call") & (F.col("tool_name") == "Bash") & command.rlike("test|jest"))
    counts = ran.groupBy("session").agg(F.count_if(low.rlike("failed|fail |error")).alias("failed"), F.count_if(low.rlike("passed|success|all tests")).alias("passed")).where("failed > 0")
    tests = counts.select("session", F.concat(F.format_string("%d test failure(s)", "failed"), F.when(F.col("passed") > 0, " (resolved)").otherwise("")).alias("risk"))
    compact = scenes.where("type = 'compaction-summary'").select("session", F.lit("Session was compacted (very long conversation)").alias("risk")).distinct()
    return files.union(tests).union(compact)


def markdown(scenes: DataFrame, rows: DataFrame) -> DataFrame:
    """(session, markdown): a summary with a header, one quoted block a phase and signals (K6)."""
    files = scenes.where("diff is not null").groupBy("session").agg(F.count_distinct(text.last_two(F.col("diff.file_path"))).alias("files"))
    whole = counted(scenes, ["session"]).select("session", "stats")
    blocks = counted(phases(scenes), ["session", "phase"])
    block = F.concat(
        F.lit("> **"), escape(condense(F.coalesce("prompt", F.lit("")), 120)), F.lit("**\n"), F.when(F.col("stats") != "", F.concat(F.lit("> "), "stats", F.lit("\n"))).otherwise(""),
        F.coalesce(F.concat(F.lit(">\n> *"), escape(condense(F.col("preview"), 120)), F.lit("*\n")), F.lit("")),
    )
    body = blocks.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("phase", block.alias("x")))), lambda x: x["x"]), "\n").alias("body"))
    signals = risks(scenes).groupBy("session").agg(F.concat(F.lit("\n**Signals:**\n"), F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "risk"))), "\n"), F.lit("\n")).alias("signals"))
    out = rows.select("session", "model", "duration_ms", "prompt_count", "tool_call_count")
    for part in (files, whole, body, signals):
        out = out.join(part, "session", "left")
    head = F.concat_ws(" · ", text.format_duration(F.col("duration_ms")), F.when(F.col("files") > 0, F.concat(F.col("files").cast("string"), F.lit(" files changed"))), "model")
    none = F.lit("")
    lines = F.concat(
        F.lit("### AI Coding Session\n\n"), head, F.lit("\n"), F.coalesce("stats", none), F.lit("\n\n<details>\n<summary>View session details ("), F.col("prompt_count").cast("string"), F.lit(" prompts, "),
        F.col("tool_call_count").cast("string"), F.lit(" tool calls)</summary>\n\n"), F.coalesce("body", none), F.coalesce("signals", none), F.lit("\n</details>\n"),
    )
    return out.select("session", lines.alias("markdown"))


def content_hash(column: Column) -> Column:
    """(K9)"""
    return F.substring(F.sha2(column, 256), 1, 16)


def uploadable(documents: DataFrame) -> DataFrame:
    """(K10)"""
    return documents.where(F.octet_length("document") <= UPLOAD_LIMIT)
