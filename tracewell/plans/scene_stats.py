"""Measures of one session's scenes, and of its sub-agents and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions import blocks, text
from tracewell.operators import joins, windows
from tracewell.plans import sessions

#: Tools that read and that write.
READING, WRITING = ("Read", "Grep", "Glob"), ("Edit", "Write")
#: Which type of scene stands for a piece of the timeline, the largest first.
PRIORITY = {"user-prompt": 4, "tool-call": 3, "text-response": 2}
SUB_AGENT_SCENES = 60


def totals(scenes: DataFrame) -> DataFrame:
    """(session, scenes, chars by type, tools, errors)."""
    size = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.length("content"))), F.lit(0))
    return scenes.groupBy("session").agg(
        F.count("*").alias("scenes"), size("user-prompt").alias("prompt_chars"), size("thinking").alias("thinking_chars"), size("text-response").alias("response_chars"),
        F.count_if(F.col("type") == "tool-call").alias("tools"), F.count_if(failed()).alias("errors"), F.sum(F.size("images")).alias("images"),
    )


def failed() -> Column:
    """Whether a shell call failed: its flag, or where there is none a word in the first 500 characters of its result."""
    told = F.substring("result", 1, 500).rlike(r"(?i)\b(?:error|fail|exception|errno)\b")
    return F.coalesce((F.col("type") == "tool-call") & (F.col("tool_name") == "Bash") & F.coalesce("is_error", told), F.lit(False))


def files(scenes: DataFrame) -> DataFrame:
    """(session, file, reads, edits, added, removed): edited files first."""
    path = F.coalesce("diff.file_path", F.when(F.col("tool_name") == "Read", F.col("input")["file_path"]))
    rows = scenes.where(F.col("type") == "tool-call").withColumn("file", path).where("file is not null")
    delta = blocks.line_delta(F.col("diff.old_content"), F.col("diff.new_content"))
    some = rows.groupBy("session", "file").agg(
        F.count_if(F.col("diff").isNull()).alias("reads"), F.count_if(F.col("diff").isNotNull()).alias("edits"), F.coalesce(F.sum(F.greatest(delta, F.lit(0))), F.lit(0)).alias("added"), F.coalesce(F.sum(F.greatest(-delta, F.lit(0))), F.lit(0)).alias("removed")
    )
    return some.orderBy(F.desc(F.col("edits") > 0), F.desc(F.col("edits") + F.col("reads")), "session", "file")


def file_grid(scenes: DataFrame, files_shown: int = 8, turns_shown: int = 60) -> DataFrame:
    """(session, file, turn, edits): the most edited files by the last turns, zeros included."""
    rows = scenes.withColumn("turn", windows.turn_id(F.col("type") == "user-prompt", ["session"], ["scene_index"])).where("turn > 0")
    cells = rows.where("diff is not null").groupBy("session", F.col("diff.file_path").alias("file"), "turn").agg(F.count("*").alias("edits"))
    top = windows.top_k(cells.groupBy("session", "file").agg(F.sum("edits").alias("n")), ["session"], [F.desc("n"), "file"], files_shown).select("session", "file")
    last = rows.groupBy("session").agg(F.max("turn").alias("last"))
    spine = last.select("session", F.explode(F.sequence(F.greatest(F.col("last") - turns_shown + 1, F.lit(1)), F.col("last"))).alias("turn"))
    return top.join(spine, "session").join(cells, ["session", "file", "turn"], "left").withColumn("edits", F.coalesce("edits", F.lit(0)))


def commands(scenes: DataFrame) -> DataFrame:
    """(session, category, n) of shell commands."""
    return scenes.where("bash is not null").groupBy("session", text.classify_command(F.col("bash.command")).alias("category")).agg(F.count("*").alias("n"))


def activity(scenes: DataFrame) -> DataFrame:
    """(session, reading, writing, running, other)."""
    name = F.col("tool_name")
    kind = F.when(name.isin(*READING), "reading").when(name.isin(*WRITING), "writing").when(name == "Bash", "running").otherwise("other")
    rows = scenes.where("type = 'tool-call'").withColumn("kind", kind)
    return rows.groupBy("session").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("reading", "writing", "running", "other")))


def timeline(scenes: DataFrame, buckets: int = 200) -> DataFrame:
    """(session, bucket, type, n): at most ``buckets`` pieces, each shown by its most important type, the first of several.

    Piece b has the scenes from floor(b * n / buckets) up to the next piece's first.
    """
    n = scenes.groupBy("session").agg(F.count("*").alias("total"))
    last_start = F.floor(((F.col("scene_index") + 1) * buckets - 1) / F.col("total"))  # the last piece that begins no later
    rows = scenes.join(n, "session").withColumn("bucket", F.when(F.col("total") <= buckets, F.col("scene_index")).otherwise(last_start))
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("type")), F.lit(1))
    return rows.groupBy("session", "bucket").agg(F.max_by("type", F.struct(rank.alias("r"), (-F.col("scene_index")).alias("i"))).alias("type"), F.count("*").alias("n"))


def first_turn(scenes: DataFrame) -> DataFrame:
    """(session, prompt, tools, last_response)."""
    rows = scenes.withColumn("turn", windows.turn_id(F.col("type") == "user-prompt", ["session"], ["scene_index"]))
    said = (F.col("type") == "text-response") & (F.length(text.strip(F.col("content"))) > 10)
    return rows.groupBy("session").agg(
        F.min_by("content", F.when(F.col("type") == "user-prompt", F.col("scene_index"))).alias("prompt"), F.count_if((F.col("turn") == 1) & (F.col("type") == "tool-call")).alias("tools"), F.max_by("content", F.when(said, F.col("scene_index"))).alias("last_response")
    )


def truncated(events: DataFrame) -> DataFrame:
    """(session, truncated): messages whose last stop reason is the token limit."""
    rows = events.where("agent is null and role = 'assistant' and msg_id is not null and stop_reason is not null").select("session", "msg_id", "ord", "stop_reason")
    last = joins.last_per_key(rows, ["session", "msg_id"], ["ord"])
    return last.groupBy("session").agg(F.count_if(F.col("stop_reason") == "max_tokens").alias("truncated"))


def api_errors(events: DataFrame) -> DataFrame:
    """(session, kind, n) of failed calls by the type of error, else by status code."""
    kind = F.coalesce(F.nullif(F.coalesce("error.error.error.type", "error.error.type"), F.lit("")), F.col("error.status").cast("string"), F.lit("unknown"))
    return events.where("agent is null and type = 'system' and subtype = 'api_error'").groupBy("session", kind.alias("kind")).agg(F.count("*").alias("n"))


def sub_agents(events: DataFrame) -> DataFrame:
    """(session, agent, tools, thinking, texts, tokens): a message's first usage counts."""
    rows = events.where("agent is not null and role = 'assistant'")
    n = lambda t: F.coalesce(F.sum(F.size(F.filter("blocks", lambda b: b["type"] == t))), F.lit(0))
    counts = rows.groupBy("session", "agent").agg(n("tool_use").alias("tools"), n("thinking").alias("thinking"), n("text").alias("texts"))
    first = joins.first_per_key(rows.where("usage is not null and msg_id is not null").select("session", "agent", "msg_id", "ord", "usage"), ["session", "agent", "msg_id"], ["ord"])
    tokens = first.groupBy("session", "agent").agg(F.sum(F.coalesce("usage.input_tokens", F.lit(0)) + F.coalesce("usage.output_tokens", F.lit(0))).alias("tokens"))
    return counts.join(tokens, ["session", "agent"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))


def sub_agent_scenes(events: DataFrame, home: str = "", limit: int = SUB_AGENT_SCENES) -> DataFrame:
    """(session, agent, rn, ts, type, content, tool_name, input, result, is_error, diff): the first ``limit`` scenes of each sub-agent, redacted, texts and results cut to 1,000 characters."""
    own = events.where("agent is not null")
    rows = own.where("role = 'assistant'").select("session", "agent", "ord", "ts", F.posexplode("blocks").alias("at", "b")).where("b.type in ('thinking', 'text', 'tool_use')")
    rows = rows.where((F.col("b.type") == "tool_use") | F.coalesce("b.thinking", "b.text").rlike(r"\S"))
    first = windows.top_k(rows, ["session", "agent"], ["ord", "at"], limit).withColumn("tool_id", F.when(F.col("b.type") == "tool_use", F.col("b.id")))
    known = first.join(sessions.tool_results(own, ("session", "agent")), ["session", "agent", "tool_id"], "left")
    tool = F.col("b.type") == "tool_use"
    kind = F.when(tool, "tool-call").when(F.col("b.type") == "text", "text-response").otherwise("thinking")
    return known.select(
        "session", "agent", "rn", "ts", kind.alias("type"),
        F.when(~tool, sessions.cut(F.coalesce("b.thinking", "b.text", F.lit("")), home, 1000)).alias("content"),
        F.col("b.name").alias("tool_name"), sessions.sanitized(F.col("b.input"), home).alias("input"),
        F.when(tool, sessions.cut(F.coalesce("result", F.lit("")), home, 1000)).alias("result"),
        F.when(tool, F.coalesce("is_error", F.lit(False))).alias("is_error"), sessions.diff(home).alias("diff"),
    )


def sub_agents_by_type(agents: DataFrame, kinds: DataFrame) -> DataFrame:
    """(session, agent_type, agents, tools, tokens), most agents first: ``sub_agents`` by the types of (session, agent, agent_type)."""
    known = agents.join(kinds.select("session", "agent", "agent_type"), ["session", "agent"], "left")
    sums = known.groupBy("session", F.coalesce(F.nullif("agent_type", F.lit("")), F.lit("unknown")).alias("agent_type"))
    return sums.agg(F.count("*").alias("agents"), F.sum("tools").alias("tools"), F.sum("tokens").alias("tokens")).orderBy("session", F.desc("agents"), "agent_type")


def agent_links(events: DataFrame) -> DataFrame:
    """(session, tool_id, agent): which sub-agent a tool call started."""
    rows = events.where("type = 'progress' and parentToolUseID is not null and data.agentId is not null")
    return joins.last_per_key(rows.select("session", F.col("parentToolUseID").alias("tool_id"), "ord", F.col("data.agentId").alias("agent")), ["session", "tool_id"], ["ord"]).drop("ord")


def agents(events: DataFrame, home: str = "", kinds: DataFrame | None = None) -> DataFrame:
    """(session, agent, sub_agent): what is known of each sub-agent, its scenes in order.

    ``kinds`` is ``logs.agent_kinds``. At most SUB_AGENT_SCENES scenes of each stand in it, which bounds the group.
    """
    own = events.where("agent is not null")
    said = F.coalesce("text", F.try_element_at(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), F.lit(1)))
    person, model = (F.col("role") == "user") & (said != ""), (F.col("role") == "assistant") & F.col("model").isNotNull() & (F.col("model") != "<synthetic>")
    about = own.groupBy("session", "agent").agg(F.min_by(F.substring(said, 1, 500), F.when(person, F.col("ord"))).alias("prompt"), F.min_by("model", F.when(model, F.col("ord"))).alias("model"))
    columns = ("type", "content", "tool_name", "input", "result", "is_error", "diff", "ts")
    scenes = sub_agent_scenes(events, home).groupBy("session", "agent").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.to_json(F.struct(*columns)).alias("scene")))), lambda x: x["scene"]).alias("scenes"))
    out = about.join(sub_agents(events), ["session", "agent"], "left").join(scenes, ["session", "agent"], "left")
    none = F.lit(None).cast("string")
    out = out.join(kinds, ["session", "agent"], "left") if kinds is not None else out.withColumn("agent_type", none).withColumn("description", none)
    prompt = sessions.clean(F.coalesce("prompt", F.lit("")), home)
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("session", "agent", F.struct(F.col("agent").alias("agent_id"), F.coalesce("agent_type", F.lit("unknown")).alias("agent_type"), "description", prompt.alias("prompt"), "model", n("tools"), n("thinking"), n("texts"), n("tokens"), F.coalesce("scenes", F.array().cast("array<string>")).alias("scenes")).alias("sub_agent"))


def with_sub_agents(scenes: DataFrame, events: DataFrame, home: str = "", kinds: DataFrame | None = None) -> DataFrame:
    """``sessions.scenes`` with ``sub_agent`` at each call that started one: its log by the progress lines that name the call.

    The scenes of a sub-agent are JSON texts, since their inputs differ in shape.
    """
    found = agent_links(events).join(agents(events, home, kinds), ["session", "agent"]).select("session", "tool_id", "sub_agent", F.lit("Agent").alias("tool_name"))
    return scenes.join(found, ["session", "tool_id", "tool_name"], "left").select(*scenes.columns, "sub_agent")


def turn_usage(events: DataFrame) -> DataFrame:
    """(session, turn, model, output, context, cache_share): each turn's first model, output tokens, largest context and share of cached input."""
    main = events.where("agent is null and role in ('user', 'assistant') and not is_meta")
    prompt = (F.col("role") == "user") & F.coalesce(F.col("text").isNotNull() | F.exists("blocks", lambda b: b["type"] == "text"), F.lit(False))
    turned = main.withColumn("turn", windows.turn_id(prompt, ["session"], ["ord"])).where("role = 'assistant' and turn > 0 and usage is not null and msg_id is not null")
    last = joins.last_per_key(turned.select("session", "msg_id", "ord", "turn", "model", "usage"), ["session", "msg_id"], ["ord"])
    use = lambda c: F.coalesce(F.col(f"usage.{c}"), F.lit(0))
    whole = use("input_tokens") + use("cache_creation_input_tokens") + use("cache_read_input_tokens")
    cached, fresh = F.sum(use("cache_read_input_tokens")), F.sum(use("input_tokens"))
    return last.groupBy("session", "turn").agg(
        F.min_by("model", F.when(F.col("model").isNotNull(), F.col("ord"))).alias("model"), F.sum(use("output_tokens")).alias("output"), F.max(whole).alias("context"), F.coalesce(F.try_divide(cached.cast("double"), cached + fresh), F.lit(0.0)).alias("cache_share")
    )


#: How many characters each kind of text may have in a digest, and how many all prompts' share is.
DIGEST = {"prompt": (3000, 25000), "response": (1500, 20000), "diff": (500, 8000), "output": (300, 5000)}
THOUGHT, COMMAND, INPUT, DIGEST_LIMIT = 200, 120, 100, 50_000


def digest(scenes: DataFrame, limit: int = DIGEST_LIMIT) -> DataFrame:
    """(session, digest): turns with their prompts, and of each turn's answer as much as its budget allows.

    The more prompts, the smaller the budgets (DIGEST). Within a turn, thoughts, texts, changes and outputs use up the budget
    of the response in order; a text is cut to what is left, and once nothing is, calls are only named. So the running
    sum of sizes tells what is shown. Behind ``limit`` characters a note stands for the rest. Sessions without a line
    have an empty digest.
    """
    prompts = scenes.groupBy("session").agg(F.greatest(F.count_if(F.col("type") == "user-prompt"), F.lit(1)).alias("prompts"))
    rows = scenes.withColumn("turn", windows.turn_id(F.col("type") == "user-prompt", ["session"], ["scene_index"])).join(prompts, "session")
    most = {k: F.least(F.lit(a), F.floor(F.lit(b) / F.col("prompts"))) for k, (a, b) in DIGEST.items()}
    said, kind = F.coalesce("content", F.lit("")), F.col("type")
    cut = lambda c, n, end="...": F.when(F.length(c) > n, F.concat(F.substring(c, F.lit(1), n if isinstance(n, Column) else F.lit(n)), F.lit(end))).otherwise(c)
    indented = lambda c: F.concat(F.lit("    "), F.replace(c, F.lit("\n"), F.lit("\n    ")))
    changed, ran = F.coalesce(F.nullif("diff.new_content", F.lit("")), "diff.old_content", F.lit("")), text.strip(F.coalesce("bash.stdout", F.lit("")))
    is_diff, is_bash = (kind == "tool-call") & F.col("diff").isNotNull(), (kind == "tool-call") & F.col("diff").isNull() & F.col("bash").isNotNull()
    # what a scene shows of itself, before the budget; a text is cut to what is left of it
    shown = (
        F.when(kind == "thinking", cut(said, THOUGHT)).when(kind == "text-response", said).when(is_diff, cut(changed, most["diff"])).when(is_bash, cut(ran, most["output"]))
    )
    rows = rows.withColumn("shown", shown).withColumn("size", F.coalesce(F.length("shown"), F.lit(0)).cast("long"))
    rows = windows.cumulative(rows, ["session", "turn"], ["scene_index"], "size", "used")
    left = most["response"] - (F.col("used") - F.col("size"))
    some = (left > 0) & (F.col("size") > 0)
    prompt = F.concat(F.lit("=== TURN "), F.col("turn").cast("string"), F.lit(" (scene "), F.col("scene_index").cast("string"), F.lit(") ===\n[USER PROMPT]:\n"), cut(said, most["prompt"], "\n...(truncated)"), F.lit("\n\n[ASSISTANT RESPONSE]:"))
    line = (
        F.when(kind == "user-prompt", prompt)
        .when((kind == "thinking") & (left > 0), F.concat(F.lit("  - Thinking: "), "shown"))
        .when((kind == "text-response") & (left > 0), F.concat(F.lit("  - Text: "), cut(said, left)))
        .when(is_diff, F.concat(F.lit("  - "), "tool_name", F.lit(": "), "diff.file_path", F.when(some, F.concat(F.lit("\n"), indented(F.col("shown")))).otherwise("")))
        .when(is_bash, F.concat(F.lit("  - Bash: "), cut(F.col("bash.command"), COMMAND), F.when(some, F.concat(F.lit("\n    Output: "), F.replace("shown", F.lit("\n"), F.lit("\n    ")))).otherwise("")))
        .when(kind == "tool-call", F.concat(F.lit("  - "), "tool_name", F.lit(": "), F.substring(F.coalesce(F.to_json("input"), F.lit("{}")), 1, INPUT)))
        .when(kind == "compaction-summary", "  - [Context compaction — earlier context was summarized]")
    )
    lines = rows.select("session", "scene_index", "turn", line.alias("line")).where("line is not null")
    ends = ~F.coalesce(F.lead("turn").over(W.partitionBy("session").orderBy("scene_index")) == F.col("turn"), F.lit(False))
    lines = lines.withColumn("line", F.concat("line", F.when(ends, "\n").otherwise("")))  # an empty line after each turn
    lines = windows.cumulative(lines.withColumn("n", (F.length("line") + 1).cast("long")), ["session"], ["scene_index"], "n", "end")
    total = lines.groupBy("session").agg((F.max("end") - 1).alias("total"))
    fit = lines.where(F.col("end") - F.col("n") < limit)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("scene_index", "line"))), lambda x: x["line"])
    text_ = fit.groupBy("session").agg(F.array_join(listed, "\n").alias("text")).join(total, "session")
    whole = F.when(F.col("total") > limit, F.concat(F.substring("text", 1, limit), F.lit("\n\n... (remaining turns omitted due to length)"))).otherwise(F.col("text"))
    return prompts.select("session").join(text_, "session", "left").select("session", F.coalesce(whole, F.lit("")).alias("digest"))
