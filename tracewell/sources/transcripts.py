"""The second provider's transcripts: JSON lines of role and blocks, with tools' outputs in text files beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions import composer, pricing, redact
from tracewell.functions import results as results_
from tracewell.functions import text as text_
from tracewell.functions.text import strip
from tracewell.operators import joins, windows
from tracewell.plans import sessions
from tracewell.sources import logs, stores

LINE = f"role string, timestamp string, message struct<content:array<{logs.BLOCK}>>"
#: Elements with which texts of the system begin.
SYSTEM_CONTEXT = "user_info|system_reminder|agent_transcripts|rules|git_status"
_STEM = r"([^/]+)\.[^./]*$"


def unwrapped(text: Column) -> Column:
    """A text without the marks of a user's query around it."""
    return strip(F.regexp_replace(text, "</?user_query>", ""))


def is_system_context(text: Column) -> Column:
    return strip(text).rlike(f"^<(?:{SYSTEM_CONTEXT})>")


def marker(text: Column) -> Column:
    """(name, body) of a text that is, or ends in, a line in bold of 2 to 120 characters, else null."""
    t = strip(text)
    name = F.regexp_extract(t, r"(?:^|\n)\*\*([^*\n]{2,120})\*\*$", 1)
    body = F.nullif(strip(F.regexp_replace(t, r"(?:^|\n+)\*\*[^*\n]{2,120}\*\*$", "")), F.lit(""))
    return F.when(name != "", F.struct(strip(name).alias("name"), body.alias("body")))


def output_tool(result: Column) -> Column:
    """The tool that an output seems to come from."""
    first = F.substring_index(result, "\n", 1)
    return (
        F.when(result.startswith("diff --git"), "Diff")
        .when(first.startswith("http://") | first.startswith("https://"), "WebFetch")
        .when(first.startswith("{") | first.startswith("["), "API")
        .when(first.rlike(r"\$ |\bCommand\b|^\w+(\s+\w+){0,3}\s+-"), "Bash")
        .otherwise("ToolOutput")
    )


def non_negative(value: Column) -> Column:
    """A number rounded, not below 0; what is no number counts as 0."""
    return F.greatest(F.coalesce(F.round(value.try_cast("double")), F.lit(0.0)), F.lit(0.0)).cast("long")


def positive_ms(value: Column) -> Column:
    """Milliseconds above 0, else null."""
    n = F.round(value.try_cast("double"))
    return F.when(n > 0, n.cast("long"))


def token_usage(counts: Column) -> Column:
    """The four counts of a JSON object in either spelling, null where all are 0."""
    pairs = (("input_tokens", ("inputTokens", "input_tokens")), ("output_tokens", ("outputTokens", "output_tokens")), ("cache_creation_input_tokens", ("cacheCreationTokens", "cache_creation_input_tokens")), ("cache_read_input_tokens", ("cacheReadTokens", "cache_read_input_tokens")))
    got = {to: non_negative(F.coalesce(*(F.get_json_object(counts, f"$.{n}") for n in names))) for to, names in pairs}
    some = sum(got.values(), F.lit(0)) > 0
    return F.when(some, F.struct(*(c.alias(n) for n, c in got.items())))


def failed(result: Column) -> Column:
    """Whether a tool's result, JSON of any depth, tells of an error."""
    return results_.told(result)["failed"]


def execution_ms(result: Column) -> Column:
    """How long a tool ran, as its result tells, directly or within its output."""
    return results_.told(result)["ms"]


def _first(args: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(F.get_json_object(args, f"$.{n}"), F.lit("")) for n in names))


def tool_args(tool: Column, args: Column) -> Column:
    """The arguments of a tool under the first provider's names: (file_path, old_string, new_string, content, command, description, pattern, raw).

    ``tool`` is the provider's own name; arguments that are no JSON object are ``raw``.
    """
    whole = F.ltrim(args).startswith("{") & F.try_parse_json(args).isNotNull()
    canonical = stores.tool_name(tool)
    edits, writes = canonical == "Edit", canonical == "Write"
    patch = F.when(tool.isin("ApplyPatch", "apply_patch"), F.coalesce(F.when(~whole, args), _first(args, "patch", "input", "content", "contents")))
    from_patch = F.nullif(F.regexp_extract(patch, r"\*\*\* (?:Update|Add|Delete) File: ([^\n]+)", 1), F.lit(""))
    side = lambda sign: F.array_join(F.transform(F.filter(F.split(patch, "\n"), lambda x: (x.startswith(sign) | x.startswith(" ")) & ~x.startswith("***") & ~x.startswith("@@")), lambda x: F.substring(x, 2, 1 << 30)), "\n")
    path = F.coalesce(F.when(whole, _first(args, "file_path", "path", "relativeWorkspacePath", "target_file")), from_patch)
    return F.struct(
        path.alias("file_path"),
        F.when(edits, F.coalesce(_first(args, "old_string", "oldStr"), F.when(patch.isNotNull(), side("-")), F.lit(""))).alias("old_string"),
        F.when(edits, F.coalesce(F.when(patch.isNull(), _first(args, "new_string", "newStr", "streamingContent", "content")), F.when(patch.isNotNull(), side("+")), F.lit(""))).alias("new_string"),
        F.when(writes, _first(args, "content", "contents", "fileText")).alias("content"),
        F.when(canonical == "Bash", _first(args, "command")).alias("command"),
        _first(args, "description").alias("description"),
        _first(args, "pattern", "query", "glob_pattern", "globPattern").alias("pattern"),
        F.when(~whole & patch.isNull(), args).alias("raw"),
    )


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the .jsonl files below ``path``, see ``parsed``."""
    return parsed(logs.raw_lines(spark, path))


def parsed(lines: DataFrame) -> DataFrame:
    """(session, ord, role, ts, blocks) of lines (path, line, raw, modified) of files named after their sessions; lines without blocks are left out.

    ``ord`` sorts by the files' times, then by lines.
    """
    whole = F.array(F.when(F.try_parse_json("raw").isNotNull(), F.from_json("raw", LINE)))
    each = lines.select("modified", "path", "line", F.explode(F.filter(whole, lambda e: e["message"]["content"].isNotNull())).alias("e"))  # a filter of rows would parse once more
    return each.select(F.regexp_extract("path", _STEM, 1).alias("session"), F.struct("modified", "path", "line").alias("ord"), F.col("e.role").alias("role"), F.nullif(F.col("e.timestamp"), F.lit("")).alias("ts"), F.col("e.message.content").alias("blocks"))


def discover(spark: SparkSession, path: str, least_lines: int = 2) -> DataFrame:
    """(session, path, modified, size, lines): transcripts of ``least_lines`` or more, newest first."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    found = rows.where(F.trim("value") != "").groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("lines"))
    return found.where(F.col("lines") >= least_lines).select(F.regexp_extract("path", _STEM, 1).alias("session"), "path", "modified", "size", "lines").orderBy(F.desc("modified"), "session")


def tool_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, modified, tool, result): outputs of tools in .txt files, empty ones left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    out = rows.select(F.regexp_extract(F.col("_metadata.file_path"), _STEM, 1).alias("id"), F.col("_metadata.file_modification_time").alias("modified"), strip(F.col("value")).alias("result"))
    return out.where("result <> ''").withColumn("tool", output_tool(F.col("result"))).select("id", "modified", "tool", "result")


#: Folders of a project's transcripts and of its tools' outputs.
_TRANSCRIPT = r"^(.*)/agent-transcripts/([^/]+)(?:/([^/]+))?\.jsonl$"
_OUTPUT = r"^(.*)/agent-tools/([^/]+)\.txt$"


def listed_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(project, session, id, path, modified): each output of a tool below ``path`` with the transcript of its project that it belongs to, from listings alone.

    That is the first one written at its time or later; outputs after all transcripts belong to none. A transcript is a file of its
    folder, or one named like the folder within that which holds it.
    """
    part = lambda pattern, n: F.regexp_extract("path", pattern, n)
    found = logs.files(spark, path).where(F.col("path").rlike(_TRANSCRIPT)).where((part(_TRANSCRIPT, 3) == "") | (part(_TRANSCRIPT, 2) == part(_TRANSCRIPT, 3)))
    transcripts = found.select(part(_TRANSCRIPT, 1).alias("project"), part(_TRANSCRIPT, 2).alias("session"), "modified")
    outputs = logs.files(spark, path, "*.txt").where(F.col("path").rlike(_OUTPUT)).select(part(_OUTPUT, 1).alias("project"), part(_OUTPUT, 2).alias("id"), "path", "modified")
    both = joins.asof_forward(outputs, transcripts, ["project"], "modified", "session")
    return both.where("next_session is not null").select("project", F.col("next_session").alias("session"), "id", "path", "modified")


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """(session, id, modified, tool, result) of the outputs of ``listed_outputs``, for ``with_outputs``."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("result"))
    rows = listed_outputs(spark, path).join(texts, "path").where("result <> ''")
    return rows.select("session", "id", "modified", output_tool(F.col("result")).alias("tool"), "result")


def turns(rows: DataFrame) -> DataFrame:
    """(session, position, role, ts, kind, text, tool_id, tool, args, result, is_error): blocks in order, each user line as one text.

    Texts of the system, image blocks and plans go. A line in bold at the end of an assistant's text is a call that waits for its output, of kind ``marker``.
    A call has its last result, and an error stays one. Lines are read in one pass and shuffled once.
    """
    none = F.lit(None).cast("string")
    is_user, is_assistant = F.col("role") == "user", F.col("role") == "assistant"

    def shown(b: Column) -> Column:
        return text_.once(unwrapped(b["text"]), lambda t: F.when(~is_system_context(t), F.nullif(composer.without_images(t), F.lit(""))))

    texts = F.filter("blocks", lambda b: b["type"] == "text")
    said = F.nullif(F.array_join(F.transform(texts, shown), "\n"), F.lit(""))
    kept = F.when(is_user, F.concat(F.transform(F.slice(texts, 1, 1), lambda b: b.withField("text", said)), F.filter("blocks", lambda b: b["type"] == "tool_result"))).otherwise(F.col("blocks"))
    uses = F.exists("blocks", lambda b: b["type"] == "tool_use").alias("uses")
    each = rows.select("session", "ord", "role", "ts", uses, F.posexplode(kept).alias("at", "b"))
    is_text, is_call = F.col("b.type") == "text", is_assistant & (F.col("b.type") == "tool_use")
    is_result = (F.col("b.type") == "tool_result") & F.col("b.tool_use_id").isNotNull() & (F.col("b.tool_use_id") != "")
    each = each.withColumn("said", F.when(is_assistant & is_text, composer.assistant_text(unwrapped(F.col("b.text")), F.col("uses")))).withColumn("m", marker(F.col("said")))
    plain = F.when(is_user & is_text, F.col("b.text")).when(F.col("m").isNotNull(), F.col("m.body")).otherwise(F.nullif("said", F.lit("")))
    name = F.coalesce(F.nullif(F.trim("b.name"), F.lit("")), F.lit("Tool"))

    def part(of: Column, kind: str, text: Column = none, tool_id: Column = none, tool: Column = none, args: Column = none, failed: Column = F.lit(None).cast("boolean")) -> Column:
        return F.when(of, F.struct(F.lit(kind).alias("kind"), text.alias("text"), tool_id.alias("tool_id"), tool.alias("tool"), args.alias("args"), failed.alias("failed")))

    parts = F.array_compact(F.array(
        part(plain.isNotNull(), "text", plain), part(F.col("m").isNotNull(), "marker", tool=F.col("m.name")),
        part(is_call, "tool", tool_id=F.nullif(F.trim("b.id"), F.lit("")), tool=name, args=F.coalesce("b.input", F.lit("{}"))),
        part(is_result, "result", F.coalesce(logs.block_text(F.col("b.content")), F.lit("")), F.col("b.tool_use_id"), failed=F.coalesce("b.is_error", F.lit(False))),
    ))
    every = each.select("session", "ord", "at", "role", "ts", F.posexplode(parts).alias("part", "p")).select("session", "ord", "at", "part", "role", "ts", "p.*")
    is_turn = F.col("kind") != "result"
    every = every.withColumn("position", (windows.turn_id(is_turn, ["session"], ["ord", "at", "part"]) - 1).cast("int"))
    of_call = W.partitionBy("session", "tool_id")
    every = every.withColumn("result", F.max_by(F.when(~is_turn, F.col("text")), F.when(~is_turn, F.struct("ord", "at"))).over(of_call)).withColumn("is_error", F.coalesce(F.max("failed").over(of_call), F.lit(False)))
    return every.where(is_turn).select("session", "position", "role", "ts", "kind", "text", "tool_id", "tool", "args", "result", "is_error")


def with_outputs(rows: DataFrame, outputs: DataFrame) -> DataFrame:
    """Turns whose markers got the outputs (session, id, modified, tool, result) of their session, one by one in order.

    A marker without an output is thinking; an output without a marker is a call after all others.
    """
    marks = rows.where("kind = 'marker'").select("session", "position", "ts", "tool")
    paired = joins.positional(marks, outputs.select("session", F.col("id").alias("out_id"), F.col("modified").alias("out_at"), F.col("tool").alias("out_tool"), F.col("result").alias("out_result")), ["session"], ["position"], ["out_at", "out_id"], "full_outer")
    last = rows.groupBy("session").agg(F.max("position").alias("last"))
    paired = paired.join(last, "session", "left").withColumn("position", F.coalesce("position", F.coalesce("last", F.lit(0)) + F.col("k")))
    has = F.col("out_id").isNotNull()
    found = paired.select(
        "session", F.col("position").cast("int").alias("position"), F.lit("assistant").alias("role"), F.coalesce("ts", F.date_format("out_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"), F.when(has, "tool").otherwise("thinking").alias("kind"),
        F.when(~has, F.col("tool")).alias("text"), F.col("out_id").alias("tool_id"), F.when(has, F.coalesce("out_tool", "tool")).alias("tool"), F.when(has & F.col("tool").isNotNull(), F.to_json(F.struct(F.col("tool").alias("marker")))).alias("args"), F.col("out_result").alias("result"), F.lit(False).alias("is_error"),
    )
    return rows.where("kind <> 'marker'").withColumn("position", F.col("position").cast("int")).unionByName(found)


def with_thinking(primary: DataFrame, transcript: DataFrame) -> DataFrame:
    """(session, turn, thinking): the k-th assistant turn of a store with the thinking of the transcript's k-th that it lacks; surplus ones at the end.

    Both sides have (session, turn, thinking) with one row for each assistant turn and ``thinking`` an array.
    """
    right = transcript.select("session", F.col("turn").alias("t2"), F.col("thinking").alias("more"))
    both = joins.positional(primary, right, ["session"], ["turn"], ["t2"], "full_outer")
    empty = F.array().cast("array<string>")
    own, more = F.coalesce("thinking", empty), F.coalesce("more", empty)
    missing = F.filter(more, lambda x: ~F.array_contains(own, x))
    out = both.select("session", F.coalesce("turn", F.lit(1 << 30) + F.col("k")).alias("turn"), F.col("turn").isNull().alias("added"), F.concat(missing, own).alias("thinking"))
    return out.where(~F.col("added") | (F.size("thinking") > 0))


def user_images(rows: DataFrame) -> DataFrame:
    """(session, turn, images): the images of each user line of ``entries`` as data addresses, numbered from 0; lines without are empty."""
    picture = lambda b: F.concat(F.lit("data:"), F.coalesce(b["source"]["media_type"], F.lit("image/png")), F.lit(";base64,"), b["source"]["data"])
    users = rows.where("role = 'user'")
    images = F.filter(F.transform(F.filter("blocks", lambda b: b["type"] == "image"), picture), lambda x: x.isNotNull())
    place = F.row_number().over(W.partitionBy("session").orderBy("ord")) - 1
    return users.select("session", place.alias("turn"), F.coalesce(images, F.array().cast("array<string>")).alias("images"))


def with_images(turns: DataFrame, images: DataFrame) -> DataFrame:
    """``turns`` (session, position, role, ...) of a store with ``images``: the k-th user turn gets those of the transcript's k-th user line."""
    users = turns.where("role = 'user' and kind = 'text'").select("session", "position")
    paired = joins.positional(users, images.select("session", F.col("turn").alias("t2"), "images"), ["session"], ["position"], ["t2"], "left").select("session", "position", "images")
    return turns.join(paired, ["session", "position"], "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


#: The second provider's names of kinds of agents.
AGENT_TYPES = {"explore": "Explore", "plan": "Plan", "generalpurpose": "general-purpose", "shell": "Shell"}


def minimal_agent(tool_id: Column, args: Column, home: str = "") -> Column:
    """(agent_id, agent_type, description, prompt) of a call that starts an agent, as far as its arguments tell; null without a type."""
    get = lambda k: F.nullif(F.trim(F.get_json_object(args, f"$.{k}")), F.lit(""))
    raw = get("subagent_type")
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in AGENT_TYPES.items() for x in kv)), F.lower(raw)), raw)
    own = F.coalesce(F.nullif(F.trim(tool_id), F.lit("")), F.concat(F.lit("cursor-agent-"), kind))
    return F.when(raw.isNotNull(), F.struct(own.alias("agent_id"), kind.alias("agent_type"), get("description").alias("description"), sessions.clean(F.coalesce(F.get_json_object(args, "$.prompt"), F.lit("")), home).alias("prompt")))


def scenes(turns: DataFrame, home: str = "") -> DataFrame:
    """Typed scenes of each session in the shape of ``sessions.scenes``, from the turns of transcripts or stores.

    Tools have their canonical names and arguments, calls of agents what is known of the agent. ``images`` and ``took`` (ms) are read where
    the turns have them. Turns without text are left out, but for prompts with images.
    """
    has = lambda c, kind: F.col(c) if c in turns.columns else F.lit(None).cast(kind)
    some = F.coalesce(has("images", "array<string>"), F.array().cast("array<string>"))
    name = stores.tool_name(F.col("tool"))
    is_tool, is_user = F.col("kind").isin("tool", "marker"), F.col("role") == "user"
    rows = turns.withColumn("images", some).withColumn("b", F.struct(name.alias("name"), F.to_json(tool_args(F.col("tool"), F.col("args"))).alias("input")))
    said, blank = F.coalesce("text", F.lit("")), F.lit("")
    command = F.get_json_object("b.input", "$.command")
    kind = F.when(is_tool, "tool-call").when(is_user, "user-prompt").when(F.col("kind") == "thinking", "thinking").otherwise("text-response")
    content = F.when(kind == "thinking", sessions.cut(said, home, 2000)).when(~is_tool, F.when(is_user & ~said.rlike(r"\S"), "(image)").otherwise(sessions.clean(said, home)))
    order = W.partitionBy("session").orderBy("position")
    took = has("took", "bigint")
    return rows.where(is_tool | said.rlike(r"\S") | is_user & (F.size("images") > 0)).select(
        "session", "ts", kind.alias("type"), content.alias("content"), F.when(is_tool, F.col("b.name")).alias("tool_name"),
        F.when(is_tool, sessions.sanitized(F.col("b.input"), home)).alias("input"), F.when(is_tool, sessions.cut(F.coalesce("result", blank), home, 5000)).alias("result"),
        F.when(is_tool, F.coalesce("is_error", F.lit(False))).alias("is_error"), F.when((took > 0) & (took < 3_600_000), took).alias("duration_ms"), F.when(is_tool, sessions.diff(home)).alias("diff"),
        F.when(is_tool & (F.col("b.name") == "Bash") & command.isNotNull(), F.struct(sessions.clean(command, home).alias("command"), sessions.cut(F.coalesce("result", blank), home, 3000).alias("stdout"))).alias("bash"),
        F.lit(None).cast("boolean").alias("is_truncated"), F.lit(None).cast("string").alias("injection"), "images", F.when(is_tool, F.col("tool_id")).alias("tool_id"),
        F.when(is_tool & (F.col("b.name") == "Agent"), minimal_agent(F.col("tool_id"), F.col("args"), home)).alias("sub_agent"), (F.row_number().over(order) - 1).alias("scene_index"),
    )


def session_rows(turns: DataFrame, home: str = "", info: DataFrame | None = None, usage: DataFrame | None = None) -> DataFrame:
    """One wide row per session in the shape of ``sessions.scan``, from its turns.

    ``info`` (session, …) has what other sources know: any of title, first_prompt, start_time, end_time, duration_ms, git_branch,
    git_branches, pr_links, model, api_error_count, compaction_count, sub_agent_count, turn_count, data_source and source_notes; what it has
    counts first, and a title stands for the first prompt. ``usage`` has (session, model, counts). Without a duration the active time of the turns counts.
    """
    rows = turns
    tool = F.col("kind") == "tool"
    canonical = stores.tool_name(F.col("tool"))
    path = F.when(tool & canonical.isin(*sessions.EDITING), F.nullif(tool_args(F.col("tool"), F.col("args"))["file_path"], F.lit("")))
    short = redact.shorten_path(path, home) if home else path
    prompt = (F.col("role") == "user") & F.col("text").rlike(r"\S")
    if "images" in turns.columns:
        prompt = prompt | (F.col("role") == "user") & (F.size("images") > 0)
    prompt = F.coalesce(prompt, F.lit(False))
    rows = rows.withColumn("file", short).withColumn("server", F.when(tool, text_.mcp_server(F.col("tool")))).withColumn("t", F.try_to_timestamp("ts"))
    rows = rows.withColumn("prompt_at", F.when(prompt, F.col("position"))).withColumn("gap", windows.capped_gap("session", "t"))
    # a row for each file and one for turns without a file, then for each session: all within the one shuffle by session
    counts = {
        "prompt_count": F.count("prompt_at"), "tool_call_count": F.count_if(tool), "edit_count": F.count("file"),
        "sub_agent_count": F.count_if(tool & (canonical == "Agent") & F.get_json_object("args", "$.subagent_type").isNotNull()), "duration_ms": F.sum("gap"),
    }
    per_file = rows.groupBy("session", "file").agg(
        F.min_by(F.substring("text", 1, 200), "prompt_at").alias("first_prompt"), F.min("prompt_at").alias("prompt_at"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        *(c.alias(n) for n, c in counts.items()), F.collect_set("server").alias("servers"), F.min("position").alias("first"),
    )
    place = F.row_number().over(W.partitionBy("session").orderBy(F.col("file").isNull(), F.desc("edit_count"), "first"))
    listed = F.when(F.col("file").isNotNull() & (F.col("rn") <= sessions.FILES_PER_SESSION), F.struct("rn", "file", F.col("edit_count").alias("edits")))
    out = per_file.withColumn("rn", place).groupBy("session").agg(
        F.min_by("first_prompt", "prompt_at").alias("first_prompt"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), *(F.sum(n).alias(n) for n in counts),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("servers")))).alias("mcp_servers_used"), F.array_sort(F.collect_list(listed)).alias("files_modified"),
    )
    files = F.transform("files_modified", lambda x: F.struct(x["file"].alias("file"), x["edits"].alias("count")))
    out = out.withColumn("files_modified", F.when(F.size("files_modified") > 0, files)).withColumn("duration_ms", F.nullif("duration_ms", F.lit(0)))
    none = lambda kind: F.lit(None).cast(kind)
    kinds = {"title": "string", "git_branch": "string", "git_branches": "array<string>", "pr_links": "array<struct<pr_number:bigint,pr_url:string,pr_repository:string>>", "model": "string", "turn_count": "bigint", "data_source": "string", "source_notes": "array<string>"}
    zeros = ("api_error_count", "compaction_count")
    out = out.withColumns({c: none(k) for c, k in kinds.items()} | {c: F.lit(0).cast("long") for c in zeros} | {"entrypoint": none("string"), "permission_mode": none("string"), "skills_used": F.array().cast("array<string>")})
    if info is not None:
        more = info.select("session", *(F.col(c).alias(f"__{c}") for c in info.columns if c in out.columns and c != "session"))
        out = out.join(more, "session", "left")
        out = out.withColumns({c[2:]: F.coalesce(F.nullif(c, F.lit(0)) if c == "__sub_agent_count" else F.col(c), F.col(c[2:])) for c in more.columns if c != "session"}).drop(*(c for c in more.columns if c != "session"))
        out = out.withColumn("first_prompt", F.coalesce("title", "first_prompt"))
    if usage is not None:
        price = pricing.cost(F.col("model"), *(F.col(c) for c in sessions.TOKENS))
        sums = usage.groupBy("session").agg(*(F.sum(c).alias(c) for c in sessions.TOKENS), F.sum(F.when(F.col("model").isNotNull(), price)).alias("cost"))
    else:
        sums = out.select("session", *(none("long").alias(c) for c in sessions.TOKENS), none("double").alias("cost"))
    out = out.join(sums, "session", "left")
    simple = F.when(F.col("input_tokens").isNotNull() & F.col("model").isNotNull(), pricing.cost(F.col("model"), *(F.col(c) for c in sessions.TOKENS)))
    return out.withColumn("cost", F.coalesce("cost", simple))


def scan(rows: DataFrame) -> DataFrame:
    """(session, first_prompt, prompt_count, tool_call_count, edit_count, files): a row for each session from its turns."""
    tool = F.col("kind") == "tool"
    canonical = stores.tool_name(F.col("tool"))
    path = F.when(tool & canonical.isin("Edit", "Write", "NotebookEdit", "Delete"), tool_args(F.col("tool"), F.col("args"))["file_path"])
    prompt = F.col("role") == "user"
    return rows.withColumn("file", path).groupBy("session").agg(
        F.min_by(F.substring("text", 1, 80), F.when(prompt, F.col("position"))).alias("first_prompt"), F.count_if(prompt).alias("prompt_count"), F.count_if(tool).alias("tool_call_count"),
        F.count("file").alias("edit_count"), F.array_sort(F.collect_set("file")).alias("files"),
    )
