"""Queries that run the readers' parsers and what is built on them, over log lines made from the driver's tables.

A conversation stands for a session of either provider: its rows become the lines, blocks and entries that the parsers take.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import blocks, layout, results, text
from tracewell.plans import catalogue, incremental, sessions
from tracewell.plans.registry import _redact_sql, query
from tracewell.sources import logs, stores, transcripts

EPOCH = 1_735_689_600  # 2025-01-01
#: Two minutes a turn.
_AT = "strftime(to_timestamp(1735689600 + turn * 120) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"


def _ts(turn="turn"):
    return F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.col(turn) * 120), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def log_lines(t):
    """(path, line, raw): each conversation as the log of a session. Assistants call a tool in each message; every second call edits one of three files."""
    odd = F.col("turn") % 2 == 1
    call = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.when(odd, "Edit").otherwise("Bash").alias("name"), F.struct(F.when(odd, F.concat(F.lit("/p/f"), (F.col("turn") % 3).cast("string"))).alias("file_path"), F.when(~odd, "make test").alias("command")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    use = F.struct((F.col("turn") * 10).alias("input_tokens"), F.col("turn").alias("output_tokens"))
    reply = F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.lit("x-sonnet-4").alias("model"), F.to_variant_object(F.array(F.to_variant_object(said), F.to_variant_object(call))).alias("content"), use.alias("usage"))
    asked = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    line = (
        F.when(F.col("role") == "user", F.to_json(F.struct(F.lit("user").alias("type"), _ts().alias("timestamp"), F.when(F.col("turn") > 2, "fix").otherwise("main").alias("gitBranch"), asked.alias("message"))))
        .when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("assistant").alias("type"), _ts().alias("timestamp"), reply.alias("message"))))
        .otherwise(F.to_json(F.struct(F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), _ts().alias("timestamp"))))
    )
    return t("conversations").select(F.format_string("/logs/c%d.jsonl", "conv_id").alias("path"), F.col("turn").alias("line"), line.alias("raw"))


@query(f"""
WITH c AS (SELECT *, 'c' || conv_id AS session, {_AT} AS ts FROM conversations), g AS (SELECT session, CASE WHEN turn - lag(turn) OVER w > 2 THEN 300000 ELSE (turn - lag(turn) OVER w) * 120000 END AS gap FROM c WINDOW w AS (PARTITION BY session ORDER BY turn)), d AS (SELECT session, nullif(sum(gap), 0)::BIGINT AS duration_ms FROM g GROUP BY 1),
f AS (SELECT session, '/p/f' || turn % 3 AS file, count(*) AS n, min(turn) AS first FROM c WHERE role = 'assistant' AND turn % 2 = 1 GROUP BY 1, 2), l AS (SELECT session, string_agg(file || ':' || n, ',' ORDER BY n DESC, first) AS files FROM f GROUP BY 1),
u AS (SELECT session, arg_max(CASE WHEN turn > 2 THEN 'fix' ELSE 'main' END, turn) AS branch, count(DISTINCT turn > 2) AS branches FROM c WHERE role = 'user' GROUP BY 1)
SELECT c.session, arg_min(substr(text, 1, 200), turn) FILTER (role = 'user' AND length(text) >= 10) AS first_prompt, min(ts) AS start_time, max(ts) AS end_time, any_value(duration_ms) AS duration_ms,
  any_value(branch) AS git_branch, any_value(CASE WHEN branches > 1 THEN 'main,fix' END) AS git_branches, count(*) FILTER (role = 'user') AS prompt_count, count(*) FILTER (role = 'assistant') AS tool_call_count, count(*) FILTER (role = 'assistant' AND turn % 2 = 1) AS edit_count,
  count(*) FILTER (role = 'system') AS compaction_count, any_value(files) AS files, sum(turn * 10) FILTER (role = 'assistant')::BIGINT AS input_tokens, round(sum(turn * 45) FILTER (role = 'assistant') / 1e6, 9) AS cost
FROM c LEFT JOIN d USING (session) LEFT JOIN l USING (session) LEFT JOIN u USING (session) GROUP BY 1""")
def log_scan(t):
    rows = sessions.scan(logs.parsed(log_lines(t)))
    listed = F.array_join(F.transform("files_modified", lambda x: F.concat_ws(":", x["file"], x["count"])), ",")
    return rows.select(
        "session", "first_prompt", "start_time", "end_time", "duration_ms", "git_branch", F.array_join("git_branches", ",").alias("git_branches"), "prompt_count", "tool_call_count", "edit_count", "compaction_count", listed.alias("files"), "input_tokens", F.round("cost", 9).alias("cost")
    )


@query(f"""
WITH c AS (SELECT *, 'c' || conv_id AS session FROM conversations), e AS (
  SELECT session, turn, 0 AS place, 'user-prompt' AS type, {_redact_sql("text")} AS content, NULL AS tool_name, NULL AS file FROM c WHERE role = 'user' AND regexp_matches(text, '\\S')
  UNION ALL SELECT session, turn, 0, 'text-response', {_redact_sql("text")}, NULL, NULL FROM c WHERE role = 'assistant' AND regexp_matches(text, '\\S')
  UNION ALL SELECT session, turn, 1, 'tool-call', NULL, CASE WHEN turn % 2 = 1 THEN 'Edit' ELSE 'Bash' END, CASE WHEN turn % 2 = 1 THEN '/p/f' || turn % 3 END FROM c WHERE role = 'assistant')
SELECT session, row_number() OVER (PARTITION BY session ORDER BY turn, place) - 1 AS scene_index, type, md5(content) AS digest, tool_name, file FROM e""")
def log_scenes(t):
    made = sessions.scenes(logs.parsed(log_lines(t)))
    return made.select("session", F.col("scene_index").cast("long").alias("scene_index"), "type", F.md5("content").alias("digest"), "tool_name", F.col("diff.file_path").alias("file"))


@query("SELECT 'c' || conv_id AS session, 'x-sonnet-4' AS model, sum(turn * 10)::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens FROM conversations WHERE role = 'assistant' GROUP BY 1")
def log_usage(t):
    return sessions.usage(logs.parsed(log_lines(t))).select("session", "model", "input_tokens", "output_tokens")


def transcript_lines(t):
    """(path, line, raw, modified): each conversation as a transcript of the second provider; assistants call a shell or edit a file."""
    odd = F.col("turn") % 2 == 1
    said = F.struct(F.lit("text").alias("type"), F.when(F.col("role") == "user", F.concat(F.lit("<user_query>"), "text", F.lit("</user_query>"))).otherwise(F.concat(F.lit("Reply: "), F.regexp_replace("text", r"[*\n]|\bI\b", "."))).alias("text"))
    call = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.when(odd, "StrReplace").otherwise("Shell").alias("name"), F.struct(F.when(odd, F.concat(F.lit("/p/f"), (F.col("turn") % 3).cast("string"))).alias("path"), F.when(~odd, "make test").alias("command")).alias("input"))
    content = F.when(F.col("role") == "user", F.to_variant_object(F.array(F.to_variant_object(said)))).otherwise(F.to_variant_object(F.array(F.to_variant_object(said), F.to_variant_object(call))))
    raw = F.to_json(F.struct("role", _ts().alias("timestamp"), F.struct(content.alias("content")).alias("message")))
    some = t("conversations").where("role <> 'system'").repartition("conv_id", "turn")  # a packed file is few splits, and lines take far longer to parse than to read
    return some.select(F.format_string("/t/c%d.jsonl", "conv_id").alias("path"), F.col("turn").alias("line"), raw.alias("raw"), F.lit(0).alias("modified"))


@query(f"""
WITH c AS (SELECT *, 'c' || conv_id AS session, {_AT} AS ts FROM conversations WHERE role <> 'system'), p AS (SELECT *, role = 'user' AND regexp_matches(text, '\\S') AS asked FROM c),
f AS (SELECT session, '/p/f' || turn % 3 AS file, count(*) AS n, min(turn) AS first FROM c WHERE role = 'assistant' AND turn % 2 = 1 GROUP BY 1, 2), l AS (SELECT session, string_agg(file || ':' || n, ',' ORDER BY n DESC, first) AS files FROM f GROUP BY 1)
SELECT session, count(*) FILTER (asked) AS prompt_count, count(*) FILTER (role = 'assistant') AS tool_call_count, count(*) FILTER (role = 'assistant' AND turn % 2 = 1) AS edit_count, min(ts) FILTER (asked OR role = 'assistant') AS start_time, max(ts) FILTER (asked OR role = 'assistant') AS end_time, any_value(files) AS files
FROM p LEFT JOIN l USING (session) GROUP BY 1""")
def transcript_rows(t):
    rows = transcripts.session_rows(transcripts.turns(transcripts.parsed(transcript_lines(t))))
    listed = F.array_join(F.transform("files_modified", lambda x: F.concat_ws(":", x["file"], x["count"])), ",")
    return rows.select("session", "prompt_count", "tool_call_count", "edit_count", "start_time", "end_time", listed.alias("files"))


def kv_rows(t):
    """(key, value): each conversation as entries of the second provider's store; assistants ran a shell whose result is nested JSON."""
    c = t("conversations").where("role <> 'system'")
    head = F.to_json(F.struct(F.max(F.format_string("name %d", "conv_id")).alias("name"), F.lit(EPOCH * 1000).alias("createdAt"), F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.struct(F.concat(F.lit("b"), x.cast("string")).alias("bubbleId"))).alias("fullConversationHeadersOnly"), F.struct(F.lit("a, x-sonnet-4").alias("modelName")).alias("modelConfig"), F.lit("main").alias("createdOnBranch"), F.struct(F.lit("fix").alias("name")).alias("committedToBranch")))
    heads = c.groupBy("conv_id").agg(head.alias("value")).select(F.format_string("composerData:c%d", "conv_id").alias("key"), F.col("value").cast("binary").alias("value"))
    inner = F.to_json(F.struct(F.when(F.col("turn") % 3 == 0, "no").alias("error"), F.concat(F.lit("out "), F.col("turn").cast("string")).alias("contents"), F.struct(F.struct(F.col("turn").alias("executionTime")).alias("success")).alias("output")))
    ran = F.struct(F.lit("run_terminal_cmd").alias("name"), F.lit('{"command":"make test"}').alias("params"), F.to_json(F.array(F.to_json(F.array(inner)))).alias("result"), F.concat(F.lit("k"), F.col("turn").cast("string")).alias("toolCallId"))
    bubble = F.to_json(F.struct(F.when(F.col("role") == "user", 1).otherwise(2).alias("type"), F.when(F.col("role") == "user", F.col("text")).alias("text"), F.when(F.col("role") == "assistant", ran).alias("toolFormerData"), ((F.lit(EPOCH) + F.col("turn") * 120) * 1000).alias("createdAt"), F.struct(F.col("turn").alias("inputTokens")).alias("tokenCount")))
    return heads.union(c.select(F.format_string("bubbleId:c%d:b%d", "conv_id", "turn").alias("key"), bubble.cast("binary").alias("value")))


@query("""
WITH c AS (SELECT *, 'c' || conv_id AS session FROM conversations WHERE role <> 'system' AND (role <> 'user' OR regexp_matches(text, '\\S')))
SELECT session, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS position, role, CASE role WHEN 'user' THEN 'text' ELSE 'tool' END AS kind, CASE role WHEN 'user' THEN md5(text) END AS digest, CASE role WHEN 'assistant' THEN 'Bash' END AS tool,
  CASE role WHEN 'assistant' THEN 'out ' || turn END AS result, role = 'assistant' AND turn % 3 = 0 AS is_error, CASE WHEN role = 'assistant' AND turn > 0 THEN turn END AS took FROM c""")
def store_turns(t):
    kv = kv_rows(t)
    made = stores.turns(stores.bubbles(kv, stores.composers(kv)))
    return made.select("session", F.col("position").cast("long").alias("position"), "role", "kind", F.md5("text").alias("digest"), "tool", "result", "is_error", "took")


@query("""
SELECT 'c' || conv_id AS session, 'name ' || conv_id AS title, 'fix' AS git_branch, 'main,fix' AS git_branches, 'x-sonnet-4' AS model, count(*) FILTER (role = 'user' AND regexp_matches(text, '\\S')) AS prompt_count, count(*) FILTER (role = 'assistant') AS tool_call_count,
  nullif(sum(turn), 0)::BIGINT AS input_tokens FROM conversations WHERE role <> 'system' GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant' OR regexp_matches(text, '\\S')) > 0""")
def store_rows(t):
    kv = kv_rows(t)
    c = stores.composers(kv)
    b = stores.bubbles(kv, c)
    rows = transcripts.session_rows(stores.turns(b), info=stores.info(c), usage=stores.usage(b))
    return rows.select("session", "title", "git_branch", F.array_join("git_branches", ",").alias("git_branches"), "model", "prompt_count", "tool_call_count", "input_tokens")


# --- texts and documents -------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT event_id, length(props) AS n, props, '{"a": "x", "p": ' || props || '}' AS whole FROM events), c AS (SELECT *, event_id % (n + 20) AS cut FROM p)
SELECT event_id, CASE WHEN cut = 0 THEN NULL WHEN cut < 9 THEN '{}' WHEN cut < 17 THEN '{"a": "x"}' WHEN cut < 16 + n THEN '{"a": "x", "p": {}}' ELSE whole END AS repaired FROM c""")
def cut_json(t):
    whole = F.concat(F.lit('{"a": "x", "p": '), "props", F.lit("}"))
    cut = F.substring(whole, F.lit(1), (F.col("event_id") % (F.length("props") + 20)).cast("int"))
    return t("events").select("event_id", blocks.repaired_json(cut).alias("repaired"))


@query()
def wrapped_texts(t):
    return t("documents").select("doc_id", F.array_join(layout.wrap(F.col("text"), 60, 3), "\n").alias("lines"), text.visual_width(F.col("text")).alias("width"))


@query("SELECT conv_id, turn, count(*) FILTER (k = 0) AS same, count(*) FILTER (k = 1) AS removed, count(*) FILTER (k = 2) AS added FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10)) || ['end']) AS line, CASE WHEN line = 'end' THEN 2 ELSE 0 END AS k FROM conversations WHERE text <> '' AND NOT contains(text, 'end')) GROUP BY 1, 2")
def appended_lines(t):
    changed = blocks.line_diff(F.col("text"), F.concat("text", F.lit("\nend")))
    kind = lambda k: F.size(F.filter("d", lambda x: x["kind"] == k)).cast("long").alias(k)
    return t("conversations").where("text <> '' and not contains(text, 'end')").select("conv_id", "turn", changed.alias("d")).select("conv_id", "turn", kind("same"), kind("removed"), kind("added"))


@query()
def line_changes(t):
    """Every document against the one before it."""
    docs = t("documents").select("doc_id", "text")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old"))
    kind = lambda k: F.size(F.filter("d", lambda x: x["kind"] == k)).cast("long").alias(k)
    return docs.join(before, "doc_id").select("doc_id", blocks.line_diff("old", "text").alias("d")).select("doc_id", kind("same"), kind("removed"), kind("added"))


_TITLE = "repeat(o_orderpriority || ' ', 20)"


@query(f"""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Missing meta.sessionId' WHEN 1 THEN 'Missing scenes array' WHEN 2 THEN 'Invalid scene at index 1: missing type' END AS error, substr({_TITLE}, 1, 200) AS title,
  least(greatest(o_custkey - 100, 0) * 1000, 100000)::BIGINT AS scene_count, CASE WHEN o_orderkey % 4 IN (2, 3) THEN o_orderstatus END AS first_message FROM orders""")
def upload_rows(t):
    m = F.col("o_orderkey") % 4
    scenes = F.array(F.struct(F.lit("user-prompt").alias("type"), F.col("o_orderstatus").alias("content")), F.struct(F.when(m == 3, "thinking").alias("type"), F.lit("c").alias("content")))
    meta = F.struct(F.when(m > 0, "s").alias("sessionId"), F.lit("p").alias("provider"), F.expr(_TITLE).alias("title"), F.struct(((F.col("o_custkey") - 100) * 1000).alias("sceneCount")).alias("stats"))
    document = F.to_json(F.struct(meta.alias("meta"), F.when(m > 1, scenes).alias("scenes")))
    row = catalogue.upload_row(F.col("d"))
    return t("orders").select("o_orderkey", document.alias("d")).select("o_orderkey", catalogue.upload_error(F.col("d")).alias("error"), row["title"].alias("title"), row["scene_count"].alias("scene_count"), row["first_message"].alias("first_message"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 AND o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 7 DAY THEN 0 ELSE round(o_totalprice) END::BIGINT AS size FROM orders")
def swept_rows(t):
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")).alias("expires_at"), F.round("o_totalprice").cast("long").alias("size"))
    return incremental.swept(rows, "1997-01-01").select("o_orderkey", "size")


@query("""
WITH a AS (SELECT event_id, (epoch_ms(TIMESTAMP '2024-01-31 12:00:00') - epoch_ms(ts)) // 60000 AS m FROM events)
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' WHEN m < 43200 THEN m // 1440 || 'd ago' END AS age, CASE WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN m // 60 || 'h' ELSE m // 1440 || 'd' END AS short FROM a WHERE m < 43200""")
def age_labels(t):
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    now = "2024-01-31 12:00:00"
    rows = t("events").where(f"ts > timestamp_ntz '{now}' - interval 30 days")
    return rows.select("event_id", text.time_ago(at, now).alias("age"), text.compact_age(at, now).alias("short"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'out' WHEN 1 THEN 'a' || chr(10) || event_type WHEN 2 THEN 'plain' || chr(10) || 'c' ELSE event_type END AS text, event_id % 4 = 2 AS failed FROM events")
def nested_results(t):
    kind = F.col("event_id") % 4
    nested = F.to_json(F.array(F.lit("a"), F.to_json(F.array("event_type"))))
    raw = F.when(kind == 0, '{"output": {"success": true}, "contents": "out"}').when(kind == 1, nested).when(kind == 2, '["plain", {"isError": true, "contents": "c"}]').otherwise(F.col("event_type"))
    told = results.told(raw)
    return t("events").select("event_id", told["text"].alias("text"), told["failed"].alias("failed"))
