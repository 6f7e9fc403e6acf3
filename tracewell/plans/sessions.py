"""From log events to one row per session, scenes, edits and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions import pricing, redact, text
from tracewell.operators import joins, windows

EDITING = ("Edit", "Write", "NotebookEdit", "Delete")
#: Types of lines that carry no message.
OTHER_TYPES = ("file-history-snapshot", "progress", "custom-title", "pr-link", "system")
TOKENS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
FILES_PER_SESSION = 100
TRACKED_FILES = 200


def messages(events: DataFrame) -> DataFrame:
    return events.where(~F.coalesce(F.col("type").isin(*OTHER_TYPES), F.lit(False)) & ~F.col("is_meta") & F.col("has_message"))


def _some(block: Column) -> Column:
    return (block["type"] == "text") & F.coalesce(block["text"].rlike(r"\S"), F.lit(False)) | (block["type"] == "_user_images")


def is_prompt() -> Column:
    """A user's line of plain text, or of blocks with text that aren't results only."""
    mixed = F.exists("blocks", _some) & ~F.forall("blocks", lambda b: b["type"] == "tool_result")
    return (F.col("role") == "user") & F.coalesce(F.col("text").isNotNull() | mixed, F.lit(False))


def edits(events: DataFrame, home: str = "") -> DataFrame:
    """(session, file, edits, first_seen): files that tools changed, sub-agents' included."""
    tools = events.where((F.col("role") == "assistant") & (F.col("agent").isNotNull() | ~F.col("is_meta"))).select("session", "ord", F.posexplode("blocks").alias("at", "b"))
    hit = tools.where((F.col("b.type") == "tool_use") & F.col("b.name").isin(*EDITING)).select("session", "ord", "at", text.tool_path(F.col("b.input")).alias("file")).where("file is not null")
    short = redact.shorten_path(F.col("file"), home) if home else F.col("file")
    return hit.groupBy("session", short.alias("file")).agg(F.count("*").alias("edits"), F.min(F.struct("ord", "at")).alias("first_seen"))


def usage(events: DataFrame) -> DataFrame:
    """(session, model, four sums): the last usage of each message (A1, A2); messages without a model have a null one."""
    rows = messages(events.where("agent is null")).where("usage is not null and msg_id is not null").select("session", "msg_id", "ord", "model", "usage")
    last = joins.last_per_key(rows, ["session", "msg_id"], ["ord"])
    real = F.when(F.col("model") != pricing.SYNTHETIC, F.col("model"))
    return last.groupBy("session", real.alias("model")).agg(*(F.sum(F.coalesce(f"usage.{c}", F.lit(0))).alias(c) for c in TOKENS))


def branches(events: DataFrame) -> DataFrame:
    """(session, git_branch, git_branches): the last branch, and the chain of changes where there are several."""
    chain = windows.consecutive_dedup(events.where("agent is null").select("session", "ord", "gitBranch"), ["session"], ["ord"], "gitBranch")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "gitBranch"))), lambda x: x["gitBranch"])
    return chain.groupBy("session").agg(ordered.alias("all")).select("session", F.element_at("all", -1).alias("git_branch"), F.when(F.size("all") > 1, F.col("all")).alias("git_branches"))


def pull_requests(events: DataFrame) -> DataFrame:
    """(session, pr_url, pr_number, pr_repository): the first link of each address."""
    rows = events.where("agent is null and type = 'pr-link' and pr_number is not null and pr_url is not null")
    return joins.first_per_key(rows.select("session", "pr_url", "pr_number", "pr_repository", "ord"), ["session", "pr_url"], ["ord"]).drop("ord")


def tracked_files(events: DataFrame, home: str = "", limit: int = TRACKED_FILES) -> DataFrame:
    """(session, tracked_files): the files that snapshots name, each once, the first ``limit`` in order."""
    file = F.col("file") if not home else redact.shorten_path(F.col("file"), home)
    each = events.where("agent is null and type = 'file-history-snapshot'").select("session", F.explode("tracked").alias("file")).select("session", file.alias("file")).distinct()
    first = windows.top_k(each, ["session"], ["file"], limit)
    return first.groupBy("session").agg(F.array_sort(F.collect_list("file")).alias("tracked_files"))


def skill() -> Column:
    """Name of the skill or command that an injected message is about."""
    said = F.coalesce(F.col("text"), F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n"))
    folder = F.nullif(F.trim(F.element_at(F.split(F.substring_index(said, "\n", 1), "/"), -1)), F.lit(""))
    ran = F.nullif(F.regexp_extract(said, r"^The user just ran /([^\s/]*)", 1), F.lit(""))
    return F.when(said.startswith("Base directory for this skill:"), folder).when(ran.isNotNull(), F.concat(F.lit("/"), ran))


def scan(events: DataFrame, home: str = "") -> DataFrame:
    """One wide row per session (S4, A3, A4, A5, A8, A40): one aggregation of the events, joined by session with edits, usage, branches and links.

    Only main files count, but for edits and the number of sub-agents. Prompts are all lines of a user with text,
    the system's included. Durations are the sum of the recorded turns, else active time. Cost needs a model.
    """
    main = events.where("agent is null")
    is_message = ~F.coalesce(F.col("type").isin(*OTHER_TYPES), F.lit(False)) & ~F.col("is_meta") & F.col("has_message")
    uses = F.filter("blocks", lambda b: b["type"] == "tool_use")
    tools = F.when(is_message & (F.col("role") == "assistant"), uses)
    servers = F.transform(F.filter(tools, lambda b: b["name"].startswith("mcp__")), lambda b: text.mcp_server(b["name"]))
    plain = is_message & (F.col("role") == "user") & (F.length("text") >= 10)
    known = is_message & F.col("model").isNotNull() & (F.col("model") != pricing.SYNTHETIC)

    def first(column: str, where: Column) -> Column:
        return F.min_by(column, F.when(where, F.col("ord")))

    def nonempty(column: str) -> Column:
        return F.col(column).isNotNull() & (F.col(column) != "")

    def system(subtype: str) -> Column:
        return F.count_if((F.col("type") == "system") & (F.col("subtype") == subtype))

    snap = (F.col("type") == "file-history-snapshot") & F.col("snapshot_ts").isNotNull() & F.col("ts").isNull()
    flat = main.groupBy("session").agg(
        F.min(F.when(F.col("ts").isNotNull(), F.col("ord"))).alias("ts_ord"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("end_time"),
        F.min(F.when(snap, F.struct("ord", "snapshot_ts"))).alias("snap"),
        F.max_by("title", F.when((F.col("type") == "custom-title") & F.col("title").isNotNull(), F.col("ord"))).alias("title"),
        F.min_by(F.substring("text", 1, 200), F.when(plain, F.col("ord"))).alias("first_prompt"),
        first("slug", nonempty("slug")).alias("slug"),
        first("cwd", nonempty("cwd")).alias("cwd"),
        first("entrypoint", nonempty("entrypoint")).alias("entrypoint"),
        first("permissionMode", nonempty("permissionMode")).alias("permission_mode"),
        first("model", known).alias("model"),
        F.count_if(is_message & is_prompt()).alias("prompt_count"),
        F.coalesce(F.sum(F.size(tools)), F.lit(0)).alias("tool_call_count"),
        system("compact_boundary").alias("compaction_count"),
        system("api_error").alias("api_error_count"),
        F.sum(F.when((F.col("type") == "system") & (F.col("subtype") == "turn_duration"), F.col("durationMs"))).cast("long").alias("turn_ms"),
        F.array_sort(F.collect_set(F.when(F.col("is_meta") & ~F.coalesce(F.col("type").isin(*OTHER_TYPES), F.lit(False)), skill()))).alias("skills_used"),
        F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set(servers))))).alias("mcp_servers_used"),
    )
    times = main.where("ts is not null").select("session", F.try_to_timestamp("ts").alias("t"))
    active = windows.active_duration(times, "session", "t")
    per_file = edits(events, home)
    top = windows.top_k(per_file, ["session"], [F.desc("edits"), "first_seen"], FILES_PER_SESSION)
    changed = per_file.groupBy("session").agg(F.sum("edits").alias("edit_count"))
    listed = top.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "file", "edits"))), lambda x: F.struct(x["file"].alias("file"), x["edits"].alias("count"))).alias("files_modified"))
    agents = events.where("agent is not null").groupBy("session").agg(F.count_distinct("agent").alias("sub_agent_count"))
    by_model = usage(events)
    price = pricing.cost(F.col("model"), *(F.col(c) for c in TOKENS))
    tokens = by_model.groupBy("session").agg(*(F.sum(c).alias(c) for c in TOKENS), F.sum(F.when(F.col("model").isNotNull(), price)).alias("model_cost"))
    links = pull_requests(events).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pr_number", "pr_url", "pr_repository"))).alias("pr_links"))
    out = flat
    for part in (active, changed, listed, agents, tokens, branches(events), links, tracked_files(events, home)):
        out = out.join(part, "session", "left")
    zero = F.lit(0).cast("long")
    before = F.col("snap").isNotNull() & (F.col("ts_ord").isNull() | (F.col("snap.ord") < F.col("ts_ord")))
    simple = F.when(F.col("input_tokens").isNotNull() & F.col("model").isNotNull(), pricing.cost(F.col("model"), *(F.col(c) for c in TOKENS)))
    return out.select(
        "session", "slug", "cwd", "title", "first_prompt",
        F.when(before, F.least("snap.snapshot_ts", "first_ts")).otherwise(F.col("first_ts")).alias("start_time"),
        "end_time",
        F.coalesce(F.nullif("turn_ms", zero), "active_ms").alias("duration_ms"),
        "git_branch", "git_branches", "pr_links", "model", "prompt_count", "tool_call_count",
        F.coalesce("edit_count", zero).alias("edit_count"), "files_modified", *TOKENS,
        F.coalesce("model_cost", simple).alias("cost"),
        F.coalesce("sub_agent_count", zero).alias("sub_agent_count"), "api_error_count", "compaction_count", "entrypoint", "permission_mode", "skills_used", "mcp_servers_used", "tracked_files",
    )


def tool_results(events: DataFrame, keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """(keys, tool_id, result, is_error, result_ts): the last result of each tool call."""
    rows = events.where("role = 'user'").select(*keys, "ord", "ts", F.posexplode("blocks").alias("at", "b")).where("b.type = 'tool_result'")
    rows = rows.select(*keys, F.col("b.tool_use_id").alias("tool_id"), F.struct("ord", "at").alias("o"), F.coalesce("b.result", F.lit("")).alias("result"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"), F.col("ts").alias("result_ts"))
    return joins.last_per_key(rows, [*keys, "tool_id"], ["o"]).drop("o")


def user_turns(events: DataFrame) -> DataFrame:
    """(session, ord, ts, kind, content, images): prompts, summaries of compaction and injected context, in order."""
    said = F.coalesce("text", F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n"), F.lit(""))
    pictures = F.transform(F.filter("blocks", lambda b: b["type"] == "image"), lambda b: F.concat(F.lit("data:"), b["source"]["media_type"], F.lit(";base64,"), b["source"]["data"]))
    rows = events.where("agent is null and type = 'user' and has_message").withColumn("content", said).withColumn("images", F.coalesce(pictures, F.array().cast("array<string>")))
    low = F.col("is_meta") & (F.col("content").startswith("<local-command-caveat>") | (F.trim("content") == "Continue from where you left off."))
    person = ~F.col("is_meta") & ~F.col("is_compact")
    machine = person & (F.col("sourceToolAssistantUUID").isNotNull() | text.is_system_generated(F.col("content")))
    kind = F.when(F.col("is_compact"), "compaction-summary").when(F.col("is_meta"), "context-injection").otherwise("user-prompt")
    some = F.col("content").rlike(r"\S") | (F.size("images") > 0)
    return rows.where(~low & ~machine & some).select("session", "ord", "ts", kind.alias("kind"), "content", "images")


def clean(content: Column, home: str) -> Column:
    return redact.redact(redact.redact_path(content, home) if home else content)


def cut(content: Column, home: str, limit: int) -> Column:
    return redact.truncate(redact.redact_path(content, home) if home else content, limit)


def diff(home: str) -> Column:
    """Both sides of what the tool call ``b`` changes, redacted; null for other tools."""
    path, blank = F.get_json_object("b.input", "$.file_path"), F.lit("")
    part = lambda name, limit=None: cut(F.get_json_object("b.input", f"$.{name}"), home, limit) if limit else clean(F.get_json_object("b.input", f"$.{name}"), home)
    old = F.when(F.col("b.name") == "Edit", F.coalesce(part("old_string"), blank)).when(F.col("b.name") == "Delete", F.coalesce(part("old_string"), F.lit("(file deleted)"))).otherwise(blank)
    new = F.when(F.col("b.name") == "Edit", F.coalesce(part("new_string"), blank)).when(F.col("b.name") == "Write", F.coalesce(part("content", 3000), blank)).otherwise(blank)
    has_diff = F.col("b.name").isin("Edit", "Write", "Delete") & path.isNotNull()
    short = redact.redact_path(path, home) if home else path
    return F.when(has_diff, F.struct(short.alias("file_path"), old.alias("old_content"), new.alias("new_content")))


def scenes(events: DataFrame, home: str = "") -> DataFrame:
    """Typed scenes of each session, numbered from 0.

    Blocks of one assistant message stand together at the message's first time; users come first at equal times.
    Texts are redacted, long ones cut, the two sides of a diff included. Nested values of a tool's input are redacted as
    JSON text. A tool's duration counts from the result before it in its message, if above 0 and below an hour.
    """
    said = events.where("agent is null and role = 'assistant' and msg_id is not null and not is_meta")
    first = said.groupBy("session", "msg_id").agg(
        F.min("ord").alias("first_ord"),
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("ord"))).alias("msg_ts"),
        F.max_by("stop_reason", F.when(F.col("stop_reason").isNotNull(), F.col("ord"))).alias("stop_reason"),
    )
    each = said.select("session", "msg_id", "ord", F.posexplode("blocks").alias("at", "b")).join(first, ["session", "msg_id"])
    each = each.withColumn("tool_id", F.when(F.col("b.type") == "tool_use", F.col("b.id"))).join(tool_results(events.where("agent is null")), ["session", "tool_id"], "left")
    began = windows.last_result_start(F.try_to_timestamp("result_ts"), F.try_to_timestamp("msg_ts"), ["session", "msg_id"], ["ord", "at"])
    took = F.unix_millis(F.try_to_timestamp("result_ts")) - F.unix_millis(began)
    each = each.withColumn("took", took)
    blank = F.lit("")
    command = F.get_json_object("b.input", "$.command")
    no_text, no_long = F.lit(None).cast("string"), F.lit(None).cast("long")
    from_blocks = each.select(
        "session", F.col("msg_ts").alias("ts"), F.lit(1).alias("side"), F.struct("first_ord", "ord", "at").alias("o"),
        F.when(F.col("b.type") == "tool_use", "tool-call").when(F.col("b.type") == "thinking", "thinking").when(F.col("b.type") == "text", "text-response").alias("type"),
        F.when(F.col("b.type") == "thinking", cut(F.col("b.thinking"), home, 2000)).when(F.col("b.type") == "text", clean(F.col("b.text"), home)).alias("content"),
        F.col("b.name").alias("tool_name"),
        sanitized(F.col("b.input"), home).alias("input"),
        F.when(F.col("b.type") == "tool_use", cut(F.coalesce("result", blank), home, 5000)).alias("result"),
        F.when(F.col("b.type") == "tool_use", F.coalesce("is_error", F.lit(False))).alias("is_error"),
        F.when((F.col("took") > 0) & (F.col("took") < 3_600_000), F.col("took")).alias("duration_ms"),
        diff(home).alias("diff"),
        F.when((F.col("b.name") == "Bash") & command.isNotNull(), F.struct(clean(command, home).alias("command"), cut(F.coalesce("result", blank), home, 3000).alias("stdout"))).alias("bash"),
        F.when(F.col("b.type") == "text", F.col("stop_reason").eqNullSafe("max_tokens")).alias("is_truncated"),
        no_text.alias("injection"), F.array().cast("array<string>").alias("images"), F.when(F.col("b.type") == "tool_use", F.col("b.id")).alias("tool_id"),
    ).where("type is not null and (type = 'tool-call' or content rlike '\\\\S')")
    prompt = (F.col("kind") == "user-prompt") & ~F.col("content").rlike(r"\S")
    none = {"tool_name": no_text, "input": F.lit(None).cast("map<string,string>"), "result": no_text, "is_error": F.lit(None).cast("boolean"), "duration_ms": no_long}
    from_users = user_turns(events).select(
        "session", "ts", F.lit(0).alias("side"), F.struct(F.col("ord").alias("first_ord"), "ord", F.lit(0).alias("at")).alias("o"), F.col("kind").alias("type"),
        F.when(prompt, "(image)").otherwise(clean(F.col("content"), home)).alias("content"),
        *(v.alias(k) for k, v in none.items()),
        F.lit(None).cast("struct<file_path:string,old_content:string,new_content:string>").alias("diff"),
        F.lit(None).cast("struct<command:string,stdout:string>").alias("bash"),
        F.lit(None).cast("boolean").alias("is_truncated"),
        F.when(F.col("kind") == "context-injection", text.classify_injection(F.col("content"))).alias("injection"), "images", no_text.alias("tool_id"),
    )
    every = from_users.unionByName(from_blocks)
    order = W.partitionBy("session").orderBy(F.try_to_timestamp("ts").asc_nulls_first(), "side", "o")
    return every.withColumn("scene_index", F.row_number().over(order) - 1).drop("side", "o")


def sanitized(input_json: Column, home: str, limit: int = 3000) -> Column:
    """A tool's input as a map of texts, each cut to ``limit`` and then redacted."""

    def one(_: Column, v: Column) -> Column:
        short = F.when(F.length(v) > limit, F.concat(F.substring(v, 1, limit), F.lit("\n... ("), F.length(v).cast("string"), F.lit(" chars total)"))).otherwise(v)
        return clean(short, home)

    return F.transform_values(F.from_json(input_json, "map<string,string>"), one)


def turn_stats(scene: DataFrame) -> DataFrame:
    """(session, turn, tools, tool_names, thinking, texts, first_index, end_index): a prompt begins a turn."""
    rows = scene.withColumn("turn", windows.turn_id(F.col("type") == "user-prompt", ["session"], ["scene_index"])).where("turn > 0")
    tools = F.col("type") == "tool-call"
    return rows.groupBy("session", "turn").agg(
        F.count_if(tools).alias("tools"), F.array_sort(F.collect_set(F.when(tools, F.col("tool_name")))).alias("tool_names"), F.count_if(F.col("type") == "thinking").alias("thinking"),
        F.count_if(F.col("type") == "text-response").alias("texts"), F.min("scene_index").alias("first_index"), F.max("scene_index").alias("end_index"),
    )


def documents(scene: DataFrame, rows: DataFrame) -> DataFrame:
    """(session, document): the replay of each session as JSON, for ``write.text`` (K1, K2)."""
    columns = [c for c in scene.columns if c != "session"]
    listed = scene.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("scene_index", F.to_json(F.struct(*columns)).alias("json")))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["json"]), ",")
    meta = rows.select("session", F.to_json(F.struct(*rows.columns)).alias("meta"))
    return meta.join(listed, "session", "left").select("session", F.concat(F.lit('{"meta":'), "meta", F.lit(',"scenes":['), F.coalesce(body, F.lit("")), F.lit("]}")).alias("document"))
