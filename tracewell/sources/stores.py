"""Key/value stores in SQLite files, read in parallel: one task opens the files of its partition in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions import composer as read
from tracewell.functions import results, text
from tracewell.operators import joins, windows
from tracewell.sources import logs

#: Type numbers of messages.
USER_TYPE = 1
SCHEMA = "path string, key string, value binary"
#: The shape of a session's id, and the size in bytes below which a store holds nothing.
SESSION_ID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
LEAST_STORE, REQUEST_ROWS = 8192, 500


def index(spark: SparkSession, path: str, least: int = LEAST_STORE) -> DataFrame:
    """(session, workspace_hash, path, length, modified): stores of ``least`` bytes or more in folders named after sessions, by a listing alone."""
    part = F.split("path", "/")
    found = logs.files(spark, path, "store.db").where(F.col("length") >= least)
    return found.select(F.element_at(part, -2).alias("session"), F.element_at(part, -3).alias("workspace_hash"), "path", "length", "modified").where(F.col("session").rlike(f"^{SESSION_ID}$"))


def with_workspace(stores: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Stores with the project whose path has the hash of their folder, null if none is known."""
    known = workspaces.select(F.col("path").alias("project")).distinct().withColumn("workspace_hash", read.workspace_hash(F.col("project")))
    return stores.join(known, "workspace_hash", "left")


def _part(n: int) -> Column:
    return F.get(F.split("key", ":"), n)


def present(wanted: DataFrame, kv: DataFrame) -> DataFrame:
    """The wanted (session, …) that the store has a conversation of."""
    have = kv.where(F.col("key").startswith("composerData:")).select(_part(1).alias("session"))
    return wanted.join(have, "session", "left_semi")


def checkpoints(kv: DataFrame) -> DataFrame:
    """(session, checkpoints)."""
    return kv.where(F.col("key").startswith("checkpointId:")).groupBy(_part(1).alias("session")).agg(F.count("*").alias("checkpoints"))


def request_contexts(kv: DataFrame, limit: int = REQUEST_ROWS) -> DataFrame:
    """(session, position, request): JSON that was sent along, the first ``limit`` of each session by key."""
    rows = kv.where(F.col("key").startswith("messageRequestContext:")).select(_part(1).alias("session"), "key", utf8(F.col("value")).alias("request"))
    return windows.top_k(rows, ["session"], ["key"], limit).where(F.try_parse_json("request").isNotNull()).select("session", F.col("rn").alias("position"), "request")


def rows(spark: SparkSession, path: str, table: str, key: str = "key", value: str = "value", prefix: str | None = None, pattern: str = "*.db") -> DataFrame:
    """(path, key, value) of a table in each SQLite file below ``path``; keys may be limited to a prefix.

    Files come as bytes through Spark's reader, so they may lie in any store; a file has to be below 2 GB. Files without
    the table, and files that aren't SQLite, give no rows; one that breaks off while it is read is an error, since its
    rows would be missing unnoticed. Values are bytes, whatever their type.
    """

    def run(batches):
        import sqlite3

        import pyarrow as pa

        low, high = (prefix or ""), (prefix[:-1] + chr(ord(prefix[-1]) + 1)) if prefix else None
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                db = sqlite3.connect(":memory:")
                try:
                    try:
                        db.deserialize(content)
                        known = db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (table,)).fetchone()
                    except sqlite3.DatabaseError:
                        known = None  # no SQLite file
                    if not known:
                        continue
                    where = f' WHERE "{key}" >= ? AND "{key}" < ?' if high else ""
                    found = db.execute(f'SELECT "{key}", CAST("{value}" AS BLOB) FROM "{table}"{where}', (low, high) if high else ())
                    while part := found.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([str(r[0]) for r in part]), pa.array([r[1] for r in part], type=pa.binary())], names=["path", "key", "value"])
                except sqlite3.Error as e:
                    raise ValueError(f"{name}: {e}") from e
                finally:
                    db.close()

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "content").mapInArrow(run, SCHEMA)


def utf8(value: Column) -> Column:
    """Bytes as text; null where they aren't UTF-8."""
    return F.try_validate_utf8(value.cast("string"))


def meta(store: DataFrame) -> DataFrame:
    """(path, agent_id, root, name, created, model): the entry under key 0, JSON in hexadecimal."""
    m = F.from_json(F.decode(F.unhex(utf8(F.col("value"))), "UTF-8"), "agentId string, latestRootBlobId string, name string, createdAt string, lastUsedModel string")
    return store.where("key = '0'").select("path", m.alias("m")).select("path", F.col("m.agentId").alias("agent_id"), F.col("m.latestRootBlobId").alias("root"), F.col("m.name").alias("name"), text.coerce_time(F.col("m.createdAt")).alias("created"), F.col("m.lastUsedModel").alias("model"))


def child_ids(value: Column) -> Column:
    """Ids of 32 bytes behind the mark 0A 20, in hexadecimal, found at whole bytes only."""
    return F.transform(F.regexp_extract_all(F.hex(value), F.lit(r"\G(?:[0-9A-F]{2})*?0A20([0-9A-F]{64})"), F.lit(1)), lambda x: F.lower(x))


def messages(metas: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, position, message): a root's children that are JSON, in order."""
    roots = metas.join(blobs.withColumnRenamed("key", "root"), ["path", "root"]).select("path", F.posexplode(child_ids(F.col("value"))).alias("position", "key"))
    return roots.join(blobs, ["path", "key"]).select("path", "position", utf8(F.col("value")).alias("message")).where(F.try_parse_json("message").isNotNull())


COMPOSER = "name string, createdAt string, lastUpdatedAt string, fullConversationHeadersOnly array<struct<bubbleId:string>>, modelConfig struct<modelName:string>, createdOnBranch string, activeBranch string"
BUBBLE = (
    "type int, text string, thinking string, createdAt string, thinkingDurationMs double, tokenCount struct<inputTokens:bigint,outputTokens:bigint,cacheCreationTokens:bigint,cacheReadTokens:bigint>, "
    "toolFormerData struct<name:string,params:string,result:string,toolCallId:string>, modelInfo struct<modelName:string>"
)


def composers(kv: DataFrame) -> DataFrame:
    """(composer, name, created, updated, model, branch, branches, headers): conversations with at least one header."""
    json = utf8(F.col("value"))
    c = kv.where(F.col("key").startswith("composerData:")).select(F.substring_index("key", ":", -1).alias("composer"), F.from_json(json, COMPOSER).alias("c"), read.branches(json).alias("b"))
    return c.where(F.size("c.fullConversationHeadersOnly") > 0).select(
        "composer", F.col("c.name").alias("name"), text.coerce_time(F.col("c.createdAt")).alias("created"), text.coerce_time(F.col("c.lastUpdatedAt")).alias("updated"),
        text.model_label(F.col("c.modelConfig.modelName")).alias("model"), F.col("b.branch").alias("branch"), read.branch_chain(F.col("b.branch"), F.col("b.chain")).alias("branches"), F.transform("c.fullConversationHeadersOnly", lambda h: h["bubbleId"]).alias("headers"),
    )


def pull_requests(kv: DataFrame, composer: DataFrame) -> DataFrame:
    """(session, pr_url, pr_number, pr_repository, position): the links in a conversation's messages."""
    b = kv.where(F.col("key").startswith("bubbleId:")).select(F.split("key", ":").alias("k"), utf8(F.col("value")).alias("bubble"))
    order = composer.select(F.col("composer").alias("session"), F.posexplode("headers").alias("position", "id"))
    return read.pull_requests(order.join(b.select(F.col("k")[1].alias("session"), F.col("k")[2].alias("id"), "bubble"), ["session", "id"]).select("session", "position", "bubble"))


def bubbles(kv: DataFrame, composer: DataFrame) -> DataFrame:
    """(composer, position, role, text, thinking, tool_id, tool, input, result, created, model, tokens): messages in the order of the headers, by one equi-join.

    ``tool`` is the canonical name. Headers without a message are left out, and plans from the assistant's texts and thoughts.
    """
    b = kv.where(F.col("key").startswith("bubbleId:")).select(F.split("key", ":").alias("k"), F.from_json(utf8(F.col("value")), BUBBLE).alias("b"))
    b = b.select(F.col("k")[1].alias("composer"), F.col("k")[2].alias("bubble"), "b").where("b is not null")
    order = composer.select("composer", F.col("model").alias("default_model"), F.posexplode("headers").alias("position", "bubble"))
    joined = order.join(b, ["composer", "bubble"])
    said = F.when(F.col("b.type") == USER_TYPE, F.col("b.text")).otherwise(read.assistant_text(F.col("b.text"), F.col("b.toolFormerData").isNotNull()))
    return joined.select(
        "composer", "position", F.when(F.col("b.type") == USER_TYPE, "user").otherwise("assistant").alias("role"), said.alias("text"), F.when(F.col("b.thinking").isNotNull(), read.thinking(F.col("b.thinking"))).alias("thinking"),
        F.col("b.toolFormerData.toolCallId").alias("tool_id"), tool_name(F.col("b.toolFormerData.name")).alias("tool"), F.col("b.toolFormerData.params").alias("input"), F.col("b.toolFormerData.result").alias("result"),
        text.coerce_time(F.col("b.createdAt")).alias("created"), F.coalesce("b.modelInfo.modelName", "default_model").alias("model"), F.col("b.tokenCount").alias("tokens"),
    )


def turns(bubbles: DataFrame) -> DataFrame:
    """(session, position, role, ts, kind, text, tool_id, tool, args, result, is_error, took): messages in the shape of ``transcripts.turns``.

    Of one message thoughts come first, then its text, then its call.
    """
    told = results.told(F.col("result"))
    each = bubbles.withColumn("told", F.when(F.col("tool").isNotNull(), told))
    thoughts = F.when(F.col("thinking").rlike(r"\S"), F.array(F.struct(F.lit("thinking").alias("kind"), F.col("thinking").alias("said"))))
    said = F.when(F.col("text").rlike(r"\S"), F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("said"))))
    call = F.when(F.col("tool").isNotNull(), F.array(F.struct(F.lit("tool").alias("kind"), F.lit(None).cast("string").alias("said"))))
    empty = F.array().cast("array<struct<kind:string,said:string>>")
    parts = each.select("*", F.posexplode(F.concat(F.coalesce(thoughts, empty), F.coalesce(said, empty), F.coalesce(call, empty))).alias("at", "part"))
    is_tool = F.col("part.kind") == "tool"
    place = F.row_number().over(W.partitionBy("composer").orderBy("position", "at")) - 1
    own = lambda c: F.when(is_tool, F.col(c))
    return parts.select(
        F.col("composer").alias("session"), place.alias("position"), "role", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.col("part.kind").alias("kind"), F.col("part.said").alias("text"),
        own("tool_id").alias("tool_id"), own("tool").alias("tool"), own("input").alias("args"), own("told.text").alias("result"), F.coalesce(own("told.failed"), F.lit(False)).alias("is_error"), own("told.ms").alias("took"),
    )


def usage(bubbles: DataFrame) -> DataFrame:
    """(session, model, four sums) of the messages that have counts (A2)."""
    count = {"input_tokens": "inputTokens", "output_tokens": "outputTokens", "cache_creation_input_tokens": "cacheCreationTokens", "cache_read_input_tokens": "cacheReadTokens"}
    n = {k: F.coalesce(F.col(f"tokens.{v}"), F.lit(0)) for k, v in count.items()}
    some = bubbles.where(sum(n.values(), F.lit(0)) > 0)
    return some.groupBy(F.col("composer").alias("session"), "model").agg(*(F.sum(c).alias(k) for k, c in n.items()))


def info(composer: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """What ``transcripts.session_rows`` takes from a store: (session, title, start_time, end_time, git_branch, git_branches, model, data_source, pr_links)."""
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    several = F.when(F.size("branches") > 1, F.col("branches"))
    out = composer.select(F.col("composer").alias("session"), text.normal_title(F.col("name")).alias("title"), time("created").alias("start_time"), time("updated").alias("end_time"), F.col("branch").alias("git_branch"), several.alias("git_branches"), "model", F.lit("global-state").alias("data_source"))
    if links is None:
        return out
    listed = F.array_sort(F.collect_list(F.struct(F.col("pr_number").cast("long").alias("pr_number"), "pr_url", "pr_repository")))
    return out.join(links.groupBy("session").agg(listed.alias("pr_links")), "session", "left")


#: Canonical names of the tools of the second provider, by its own.
TOOL_NAMES = {
    "Shell": "Bash",
    "run_terminal_command_v2": "Bash",
    "run_terminal_cmd": "Bash",
    "Read": "Read",
    "ReadFile": "Read",
    "read_file_v2": "Read",
    "read_file": "Read",
    "read_lints": "ReadLints",
    "Grep": "Grep",
    "ripgrep_raw_search": "Grep",
    "ripgrep": "Grep",
    "rg": "Grep",
    "grep": "Grep",
    "grep_search": "Grep",
    "Glob": "Glob",
    "glob_file_search": "Glob",
    "file_search": "Glob",
    "list_dir": "Glob",
    "list_dir_v2": "Glob",
    "LS": "Glob",
    "StrReplace": "Edit",
    "EditFile": "Edit",
    "edit_file_v2": "Edit",
    "edit_file": "Edit",
    "search_replace": "Edit",
    "ApplyPatch": "Edit",
    "apply_patch": "Edit",
    "Write": "Write",
    "WriteFile": "Write",
    "write": "Write",
    "Delete": "Delete",
    "delete_file": "Delete",
    "Task": "Agent",
    "task_v2": "Agent",
    "todo_write": "TodoWrite",
    "ask_question": "AskQuestion",
    "semantic_search_full": "SemanticSearch",
    "codebase_search": "SemanticSearch",
    "web_search": "WebSearch",
    "WebFetch": "WebFetch",
    "web_fetch": "WebFetch",
    "create_plan": "Plan",
}
#: Names that begin so belong to the browser.
BROWSER = ("mcp-cursor-ide-browser-cursor-ide-browser-browser_", "chrome-devtools-")


def tool_name(name: Column) -> Column:
    """The canonical name of a tool, else the name itself (P10)."""
    known = F.create_map(*(F.lit(x) for pair in TOOL_NAMES.items() for x in pair))
    browser = F.when(name.startswith(BROWSER[0]) | name.startswith(BROWSER[1]), "Browser")
    return F.coalesce(F.try_element_at(known, name), browser, name)


def only_here(found: DataFrame, known: DataFrame, key: str, limit: int) -> DataFrame:
    """Sessions of one store that no other source has, the newest ``limit`` of each project."""
    return windows.top_k(found.join(known.select(key), key, "left_anti"), ["project"], [F.desc("updated"), key], limit)


def enriched(primary: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per-turn measures of two stores, the primary one's first."""
    return joins.coalesced(primary, other, [key, "turn"], fields)
