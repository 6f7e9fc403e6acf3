"""Session logs: one JSON object a line, in a file for each session and one for each sub-agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions.text import clean_prompt, is_system_generated, strip

#: Blocks of a message; ``input`` stays JSON text, a result's ``content`` is text or again blocks.
BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:variant,is_error:boolean,source:struct<media_type:string,data:string>>"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"
LINE = (
    "struct<type:string,subtype:string,sessionId:string,slug:string,cwd:string,version:string,timestamp:string,gitBranch:string,entrypoint:string,"
    "permissionMode:string,isMeta:boolean,isCompactSummary:boolean,sourceToolAssistantUUID:string,durationMs:double,customTitle:string,title:string,"
    "prNumber:bigint,prUrl:string,prRepository:string,parentToolUseID:string,retryAttempt:bigint,error:struct<status:bigint,error:struct<type:string,error:struct<type:string,message:string>>>,snapshot:struct<timestamp:string,trackedFileBackups:map<string,string>>,"
    "data:struct<type:string,agentId:string,prNumber:bigint,prUrl:string,prRepository:string>,"
    f"message:struct<role:string,id:string,model:string,stop_reason:string,content:variant,usage:{USAGE}>>"
)
_AGENT = r"/([^/]+)/subagents/(?:agent-)?([^/]+)\.jsonl$"
_FILE = r"([^/]+)\.jsonl$"


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def block_text(v: Column) -> Column:
    """Text of a content that is a string or an array of blocks, whose texts are joined by line feeds."""
    blocks = F.from_json(F.to_json(v), f"array<{BLOCK}>")
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    other = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(texts, "\n")).otherwise(F.to_json(v))
    return F.when(is_text(v), F.variant_get(v, "$", "string")).otherwise(other)


def raw_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, line, raw, modified): all lines of the files below ``path`` but blank ones; ``line`` sorts those of a file.

    Large files are read in splits of ``spark.sql.files.maxPartitionBytes``, a line by the split in which it begins. ``line``
    is the byte where its split begins, with a number that grows along the rows of a task.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    some = rows.where(F.trim(F.col("value"), F.lit(" \t\r")) != "")
    line = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return some.select(F.col("_metadata.file_path").alias("path"), line.alias("line"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("modified"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, raw) of all .jsonl files below ``path``, blank and unparsable lines left out."""
    return raw_lines(spark, path).select("path", "line", "raw").where(F.try_parse_json("raw").isNotNull())


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (path, line, ...) of ``raw_lines`` with ``line_no`` from 0 and ``n_lines`` of the file: from a count of each split, without a shuffle of lines."""
    splits = rows.groupBy("path", F.col("line.split").alias("split")).agg(F.min("line.row").alias("first"), F.count("*").alias("n"))
    each = W.partitionBy("path")
    before = F.coalesce(F.sum("n").over(each.orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("path", "split", "first", before.alias("before"), F.sum("n").over(each).alias("n_lines"))
    out = rows.withColumn("split", F.col("line.split")).join(splits, ["path", "split"])
    return out.withColumn("line_no", F.col("before") + F.col("line.row") - F.col("first")).drop("split", "first", "before")


def events(spark: SparkSession, path: str, sessions: DataFrame | None = None) -> DataFrame:
    """The events of all files below ``path``, see ``parsed``."""
    return parsed(raw_lines(spark, path), sessions)


def saved(rows: DataFrame, path: str) -> DataFrame:
    """Events written as a table and read from it, so that what reads them several times parses them once."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def parsed(lines: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """One typed row per line of (path, line, raw): session, agent (null in a main file), ord, fields of the line, text and blocks.

    A file belongs to the session that it is named after, a sub-agent's file to that of its folder. ``sessions``
    (file, session, file_seq) joins the files of resumed sessions, in that order. ``line`` may be of any kind that sorts a
    file's lines. Lines that aren't JSON objects are left out.
    """
    rows = lines.where(F.try_parse_json("raw").isNotNull()).withColumn("e", F.from_json("raw", LINE))
    agent = F.nullif(F.regexp_extract("path", _AGENT, 2), F.lit(""))
    owner = F.when(agent.isNotNull(), F.regexp_extract("path", _AGENT, 1)).otherwise(F.regexp_extract("path", _FILE, 1))
    rows = rows.withColumn("agent", agent).withColumn("file", owner)
    if sessions is None:
        rows = rows.withColumn("session", F.col("file")).withColumn("file_seq", F.lit(0))
    else:
        rows = rows.join(sessions.select("file", "session", "file_seq"), "file")
    content = F.col("e.message.content")
    blocks = F.from_json(F.to_json(content), f"array<{BLOCK}>")
    typed = F.transform(
        blocks,
        lambda b: F.struct(*(b[c].alias(c) for c in ("type", "text", "thinking", "id", "name", "input", "tool_use_id", "is_error", "source")), block_text(b["content"]).alias("result")),
    )
    return rows.select(
        "session",
        "agent",
        F.struct("file_seq", "path", "line").alias("ord"),
        *(F.col(f"e.{c}").alias(c) for c in ("type", "subtype", "sessionId", "slug", "cwd", "gitBranch", "entrypoint", "permissionMode", "sourceToolAssistantUUID", "durationMs", "parentToolUseID", "retryAttempt", "error", "data")),
        F.nullif(F.col("e.timestamp"), F.lit("")).alias("ts"),
        F.nullif(F.col("e.snapshot.timestamp"), F.lit("")).alias("snapshot_ts"),
        F.map_keys("e.snapshot.trackedFileBackups").alias("tracked"),
        F.coalesce("e.isMeta", F.lit(False)).alias("is_meta"),
        F.coalesce("e.isCompactSummary", F.lit(False)).alias("is_compact"),
        F.coalesce(F.nullif("e.customTitle", F.lit("")), F.nullif("e.title", F.lit(""))).alias("title"),
        F.coalesce("e.data.prNumber", "e.prNumber").alias("pr_number"),
        F.coalesce("e.data.prUrl", "e.prUrl").alias("pr_url"),
        F.coalesce("e.data.prRepository", "e.prRepository", F.lit("")).alias("pr_repository"),
        F.col("e.message").isNotNull().alias("has_message"),
        F.col("e.message.role").alias("role"),
        F.nullif("e.message.id", F.lit("")).alias("msg_id"),
        F.nullif("e.message.model", F.lit("")).alias("model"),
        F.col("e.message.stop_reason").alias("stop_reason"),
        F.col("e.message.usage").alias("usage"),
        F.when(is_text(content), F.variant_get(content, "$", "string")).alias("text"),
        F.when(~is_text(content), typed).alias("blocks"),
    )


def files(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, length, modified): a listing without contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def agent_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(session, agent, agent_type, description) from the .meta.json files beside the logs of sub-agents (S3)."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "agentType string, description string").alias("m"))
    of = r"/([^/]+)/subagents/(?:agent-)?([^/]+)\.meta\.json$"
    rows = whole.select(F.regexp_extract("path", of, 1).alias("session"), F.regexp_extract("path", of, 2).alias("agent"), F.coalesce(F.nullif("m.agentType", F.lit("")), F.lit("unknown")).alias("agent_type"), F.col("m.description").alias("description"))
    return rows.where("agent <> ''")


def memory_notes(spark: SparkSession, path: str, limit: int = 2000) -> DataFrame:
    """(path, name, description, kind, content) of Markdown notes with a header between --- lines."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    header, body = F.regexp_extract("value", r"\A---\n([\s\S]*?)\n---\n?", 1), F.regexp_replace("value", r"\A---\n[\s\S]*?\n---\n?", "")

    def entry(key: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(header, rf"(?m)^{key}:[ \t]*(.*)$", 1)), F.lit(""))

    return text.select("path", entry("name").alias("name"), entry("description").alias("description"), entry("type").alias("kind"), F.substring(strip(body), 1, limit).alias("content"))


def header_sample(spark: SparkSession, path: str, head: int = 150, metadata: int = 30, tail: int = 50, prompts: int = 2, model_prefix: str = "claude-") -> DataFrame:
    """A row for each session's file, from a sample of its lines and from expressions over all raw ones.

    session_id, slug, cwd, version and git_branch are the first that aren't empty among the first ``metadata`` lines; title
    the last among these, else the last of the last ``tail`` lines; timestamp the first snapshot's among the first, else
    that of the last system line among the last ten, else the file's. ``prompts`` are the first cleaned prompts with ten
    characters or more of the first ``head`` lines, cut to 200; files without one, or without a session id, are left out.
    prompt_count, tool_calls, edits (lines with an editing call), model, duration_ms and has_pr only look at the raw text.
    """
    rows = numbered(raw_lines(spark, path))
    no, last = F.col("line_no"), F.col("n_lines")
    field = lambda name: F.nullif(F.get_json_object("raw", f"$.{name}"), F.lit(""))
    sampled = (no < head) | (no >= last - tail)
    known = rows.withColumn("type", F.when(sampled, field("type")))
    first = lambda value, where: F.min_by(value, F.when(where & value.isNotNull(), no))
    latest = lambda value, where: F.max_by(value, F.when(where & value.isNotNull(), no))
    early = no < metadata
    named = F.when(F.col("type") == "custom-title", F.coalesce(field("customTitle"), field("title")))
    snapshot = F.when(F.col("type") == "file-history-snapshot", field("snapshot.timestamp"))
    system = F.when(F.col("type") == "system", field("timestamp"))
    content = F.get_json_object("raw", "$.message.content")
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    said = F.when(content.startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")).otherwise(content)
    asked = (no < head) & (F.col("type") == "user") & (F.get_json_object("raw", "$.message.role") == "user")
    prompt = F.when(asked & ~is_system_generated(said), clean_prompt(said))
    known = known.withColumn("prompt", F.when(F.length(prompt) >= 10, F.substring(prompt, 1, 200)))
    raw = F.col("raw")
    calls = F.regexp_count(raw, F.lit(r'"type"\s*:\s*"tool_use"'))
    model = F.nullif(F.regexp_extract(raw, rf'"model"\s*:\s*"({model_prefix}[^"]+)"', 1), F.lit(""))
    out = known.groupBy("path").agg(
        *(first(field(c), early).alias(n) for c, n in (("sessionId", "session_id"), ("slug", "slug"), ("cwd", "cwd"), ("version", "version"), ("gitBranch", "git_branch"))),
        F.coalesce(latest(named, early), latest(named, no >= last - tail)).alias("title"),
        F.coalesce(first(snapshot, early), latest(system, no >= last - 10), F.date_format(F.max("modified"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("timestamp"),
        F.max("n_lines").alias("n_lines"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("prompt").isNotNull(), F.struct("line_no", "prompt")))), 1, prompts), lambda x: x["prompt"]).alias("prompts"),
        F.count_if(raw.rlike(r'"type": ?"user"') & ~raw.contains('"tool_result"')).alias("prompt_count"),
        F.sum(calls).alias("tool_calls"),
        F.count_if((calls > 0) & raw.rlike(r'"name"\s*:\s*"(?:Edit|Write|MultiEdit|NotebookEdit)"')).alias("edits"),
        first(model, raw.contains('"assistant"')).alias("model"),
        F.sum(F.when(raw.contains('"turn_duration"'), F.regexp_extract(raw, r'"durationMs"\s*:\s*(\d+)', 1).try_cast("long"))).alias("duration_ms"),
        F.max(raw.contains('"pr-link"')).alias("has_pr"),
    )
    return out.where(F.col("session_id").isNotNull() & (F.size("prompts") > 0)).withColumn("slug", F.coalesce("slug", F.substring("session_id", 1, 8)))
