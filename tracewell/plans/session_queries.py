"""Queries that run the session operators themselves over the driver's tables, shaped like a scan and like scenes.

Orders stand in for sessions and order lines for their edits; events stand in for scenes of a user's session.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions import composer
from tracewell.plans import catalogue, export, incremental, insights, scene_stats, sessions
from tracewell.plans.registry import clean_sql, query

TODAY = "1998-08-02"
_TOTALS = ("prompt_count", "tool_call_count", "edit_count", "sub_agent_count", "api_error_count", "compaction_count", "input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
#: Expressions that Spark and DuckDB read alike; k is the order's key.
_ROW = {
    "session": "k",
    "project": "concat('p', o_custkey)",
    "provider": "o_orderstatus",
    "start_time": "concat(d, 'T10:00:00Z')",
    "end_time": "case when k % 7 = 0 then null else concat(d, 'T11:00:00Z') end",
    "duration_ms": "case when k % 10 = 0 then null else (k % 10) * 1000 end",
    "prompt_count": "k % 5",
    "tool_call_count": "k % 11",
    "edit_count": "k % 3",
    "sub_agent_count": "k % 2",
    "api_error_count": "k % 4",
    "compaction_count": "k % 2",
    "input_tokens": "case when k % 13 = 0 then null else k % 1000 end",
    "output_tokens": "k % 100",
    "cache_creation_input_tokens": "k * 0",
    "cache_read_input_tokens": "k % 50",
    "cost": "case when k % 13 = 0 then null else cast(k % 100 as double) / 4 end",
    "model": "case when k % 17 = 0 then null else o_orderpriority end",
    "git_branch": "case when k % 4 = 0 then o_orderstatus else o_orderpriority end",
    "first_branch": "case when k % 4 = 0 then o_orderpriority end",
    "pr": "case when k % 6 = 0 then k % 50 end",
}
S = "o AS (SELECT *, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders), s AS (SELECT " + ", ".join(f"{v} AS {n}" for n, v in _ROW.items()) + " FROM o)"
DAY = "CAST(substr(start_time, 1, 10) AS DATE)"


#: Order lines of a task; Spark would put together what is 64 MB when packed, ten times as many.
LINES_A_TASK = 250_000


def _parts(t):
    """Tasks for the order lines, by their number in the table's footers."""
    return max(16, -(-t("lineitem").count() // LINES_A_TASK))


def session_rows(t, parts=None):
    """Order rows in the shape of ``sessions.scan`` with project and provider; queries that read the files deal order lines to ``parts`` tasks."""
    base = t("orders").select("*", F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    rows = base.select(*(F.expr(v).alias(n) for n, v in _ROW.items()))
    lines = t("lineitem").select(F.col("l_orderkey").alias("session"), "l_partkey", "l_quantity")
    lines = lines if parts is None else lines.repartition(parts, "session")
    edited = lines.groupBy("session", F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file")).agg(F.sum("l_quantity").cast("long").alias("count"))
    files = edited.groupBy("session").agg(F.collect_list(F.struct("file", "count")).alias("files_modified"))
    link = F.struct(F.col("pr").alias("pr_number"), F.concat(F.lit("u"), F.col("pr").cast("string")).alias("pr_url"), F.lit("r").alias("pr_repository"))
    rows = rows.withColumn("git_branches", F.when(F.col("first_branch").isNotNull(), F.array("first_branch", "git_branch"))).withColumn("pr_links", F.when(F.col("pr").isNotNull(), F.array(link)))
    return rows.drop("first_branch", "pr").join(files, "session", "left")


_SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in _TOTALS)
_AGG = (
    f"count(*) AS sessions, {_SUMS}, coalesce(sum(CASE WHEN duration_ms > 0 THEN duration_ms END), 0)::BIGINT AS duration_ms, floor(avg(CASE WHEN duration_ms > 0 THEN duration_ms END) + 0.5)::BIGINT AS avg_duration_ms, "
    f"coalesce(sum(cost), 0) AS cost, min(start_time) AS first_activity, max(coalesce(end_time, start_time)) AS last_activity, count(DISTINCT {DAY}) AS active_days"
)
_BRANCHES = "b AS (SELECT DISTINCT session, project, branch FROM (SELECT session, project, git_branch AS branch FROM s UNION ALL SELECT session, project, first_branch FROM s) WHERE branch IS NOT NULL)"


@query(
    f"WITH {S}, {_BRANCHES}, p AS (SELECT project, {_AGG} FROM s GROUP BY 1), n AS (SELECT project, count(DISTINCT branch) AS branches FROM b GROUP BY 1), l AS (SELECT project, count(DISTINCT pr) AS pull_requests FROM s WHERE pr IS NOT NULL GROUP BY 1) "
    "SELECT p.*, coalesce(branches, 0) AS branches, coalesce(pull_requests, 0) AS pull_requests FROM p LEFT JOIN n USING (project) LEFT JOIN l USING (project)"
)
def session_projects(t):
    return insights.projects(session_rows(t))


@query(
    f"WITH {S}, {_BRANCHES} SELECT {_AGG}, count(DISTINCT project) AS projects, (SELECT count(*) FROM (SELECT DISTINCT project, branch FROM b)) AS branches, "
    "(SELECT count(DISTINCT pr) FROM s WHERE pr IS NOT NULL) AS pull_requests FROM s"
)
def session_user(t):
    return insights.user(session_rows(t))


@query(
    f"WITH {S}, {_BRANCHES}, l AS (SELECT project, git_branch AS branch, count(DISTINCT pr) AS n FROM s WHERE pr IS NOT NULL GROUP BY 1, 2) "
    "SELECT b.project, b.branch, count(DISTINCT session) AS sessions, coalesce(any_value(l.n), 0) AS pull_requests FROM b LEFT JOIN l USING (project, branch) GROUP BY 1, 2"
)
def session_branches(t):
    return insights.branches(session_rows(t))


@query(
    f"WITH {S}, e AS (SELECT l_orderkey AS session, 'f' || l_partkey AS file, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT project, file, sum(n)::BIGINT AS edits, count(DISTINCT session) AS sessions FROM s JOIN e USING (session) GROUP BY 1, 2) "
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY edits DESC, file)::INTEGER AS rn FROM g) WHERE rn <= 20"
)
def session_hot_files(t):
    parts = _parts(t)
    return insights.hot_files(session_rows(t, parts), parts=parts)


@query(f"""
WITH {S}, c AS (SELECT {DAY} AS day, count(*) AS n FROM s GROUP BY 1), g AS (SELECT (DATE '1998-08-08' - i::INTEGER) AS day FROM generate_series(0, 363) x(i)), j AS (SELECT day, coalesce(n, 0)::BIGINT AS sessions FROM g LEFT JOIN c USING (day))
SELECT day, sessions, CASE WHEN sessions = 0 THEN 0 ELSE least(4, ceil(4.0 * sessions / greatest(max(sessions) OVER (), 1)))::INTEGER END AS level FROM j""")
def session_heatmap(t):
    return insights.heatmap(session_rows(t), TODAY)


@query(f"WITH {S}, c AS (SELECT dayofweek({DAY})::INTEGER AS dow, count(*) AS n FROM s GROUP BY 1) SELECT d.dow, coalesce(n, 0)::BIGINT AS sessions FROM (SELECT unnest(generate_series(0, 6))::INTEGER AS dow) d LEFT JOIN c USING (dow)")
def session_weekdays(t):
    return insights.weekdays(session_rows(t))


_WEEKS = f"c AS (SELECT date_trunc('week', {DAY})::DATE AS week, count(*) AS n FROM s GROUP BY 1), g AS (SELECT (date_trunc('week', DATE '{TODAY}') - to_days(CAST(7 * i AS INTEGER)))::DATE AS week FROM generate_series(0, {{}}) x(i)), w AS (SELECT week, coalesce(n, 0)::BIGINT AS sessions FROM g LEFT JOIN c USING (week))"


@query(f"WITH {S}, {_WEEKS.format(11)} SELECT * FROM w")
def session_weeks(t):
    return insights.weeks(session_rows(t), TODAY)


@query(
    f"WITH {S}, {_WEEKS.format(7)}, r AS (SELECT sum(CASE WHEN week > date_trunc('week', DATE '{TODAY}')::DATE - 28 THEN sessions ELSE 0 END) / 4 AS recent, sum(CASE WHEN week > date_trunc('week', DATE '{TODAY}')::DATE - 28 THEN 0 ELSE sessions END) / 4 AS prior FROM w) "
    "SELECT recent, prior, CASE WHEN prior <> 0 THEN (recent - prior) / prior END AS change FROM r"
)
def session_trend(t):
    return insights.trend(session_rows(t), TODAY)


@query(
    f"WITH {S}, r AS (SELECT count(*) FILTER ({DAY} >= DATE '{TODAY}' - 400) AS n, count(*) AS m, sum(prompt_count) AS a, sum(tool_call_count) AS b, sum(edit_count) AS c, sum(cost) AS d FROM s) "
    "SELECT n AS sessions, round(a * n / m, 3) AS prompt_count, round(b * n / m, 3) AS tool_call_count, round(c * n / m, 3) AS edit_count, round(d * n / m, 3) AS cost FROM r"
)
def session_scaled(t):
    out = insights.scaled(session_rows(t), TODAY, 400)
    return out.select("sessions", *(F.round(c, 3).alias(c) for c in ("prompt_count", "tool_call_count", "edit_count", "cost")))


@query(f"WITH {S} SELECT model, count(*) AS sessions, round(count(*) / (SELECT count(*) FROM s), 9) AS share FROM s GROUP BY 1")
def session_models(t):
    return insights.shares(session_rows(t), "model").withColumn("share", F.round("share", 9))


_SOURCE = "CASE session % 3 WHEN 0 THEN 'sqlite' WHEN 1 THEN 'jsonl' END"


def second_provider_rows(t):
    """``session_rows`` with the columns that tell where measures come from; provider F stands for the second one."""
    note = F.when(F.col("session") % 5 == 0, F.array(F.lit("Session duration is estimated."), F.lit("No per-turn stats."))).when(F.col("session") % 5 == 1, F.array(F.lit("Token counts are partial.")))
    return session_rows(t).withColumn("data_source", F.expr(_SOURCE)).withColumn("source_notes", note).withColumn("turn_count", F.col("session") % 2)


@query(f"""
WITH {S}, n AS (SELECT session, CASE WHEN provider = 'F' AND session % 3 = 0 THEN 'Some Cursor metrics are best-effort estimates and may be incomplete.' END AS a,
  CASE session % 5 WHEN 0 THEN 'Session duration is estimated.;No per-turn stats.' WHEN 1 THEN 'Token counts are partial.' END AS b, CASE WHEN input_tokens IS NULL THEN 'Token and cost metrics may be unavailable.' END AS c FROM s)
SELECT session, concat_ws(';', a, b, c) AS notes, CASE WHEN session % 5 = 0 THEN 'Session duration is estimated.' END AS duration_note, coalesce(CASE WHEN session % 5 = 1 THEN b END, c) AS tokens_note FROM n""")
def session_notes(t):
    return insights.with_quality(second_provider_rows(t), "F").select("session", F.array_join("notes", ";").alias("notes"), "duration_note", "tokens_note")


@query(f"""
WITH {S}, q AS (SELECT count(*) AS total, count(*) FILTER (session % 5 = 0) AS e, count(*) FILTER (duration_ms IS NULL) AS d, count(*) FILTER (input_tokens IS NULL) AS k, count(*) FILTER (session % 2 = 0) AS u FROM s WHERE provider = 'F')
SELECT total, e AS estimated, d AS no_duration, k AS no_tokens, u AS no_turn_stats, concat_ws(';', e || '/' || total || ' Cursor sessions use best-effort duration estimates.', d || '/' || total || ' Cursor sessions do not have enough timing data to compute duration.',
  k || '/' || total || ' Cursor sessions do not include token snapshots, so token and cost totals are partial.', u || '/' || total || ' Cursor sessions do not include per-turn stats.') AS notes FROM q""")
def session_quality(t):
    return insights.quality(second_provider_rows(t), "F").withColumn("notes", F.array_join("notes", ";"))


@query(f"""
WITH {S}, d AS (SELECT DISTINCT provider, {DAY} AS d FROM s), g AS (SELECT provider, d, d - (row_number() OVER (PARTITION BY provider ORDER BY d))::INTEGER AS g FROM d), r AS (SELECT provider, count(*) AS n, min(d) AS s, max(d) AS e FROM g GROUP BY provider, g)
SELECT provider, max(n) AS longest, arg_min(s, (-n, s)) AS longest_start, coalesce(max(CASE WHEN e >= DATE '{TODAY}' - 1 THEN n END), 0) AS current FROM r GROUP BY 1""")
def session_streaks(t):
    return insights.streak(session_rows(t), TODAY)


@query("""
SELECT o_custkey AS project, o_orderpriority AS slug, arg_max(o_orderstatus, (o_orderdate, lpad(o_orderkey::VARCHAR, 12, '0'))) AS status, sum(round(o_totalprice))::BIGINT AS size, sum(o_orderkey % 5)::BIGINT AS prompts, sum(o_orderkey % 7)::BIGINT AS tool_calls,
string_agg(lpad(o_orderkey::VARCHAR, 12, '0'), ',' ORDER BY o_orderdate, o_orderkey) AS paths FROM orders GROUP BY 1, 2""")
def catalogue_parts(t):
    parts = t("orders").select(
        F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("slug"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("modified"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"),
        F.round("o_totalprice").cast("long").alias("size"), (F.col("o_orderkey") % 5).alias("prompts"), (F.col("o_orderkey") % 7).alias("tool_calls"),
    )
    return insights.latest_of_parts(parts).select("project", "slug", "status", "size", "prompts", "tool_calls", F.array_join("paths", ",").alias("paths"))


@query("""
WITH r AS (SELECT o_orderkey AS slug, o_custkey AS sid, o_orderkey AS replay FROM orders WHERE o_orderkey % 3 = 0), a AS (SELECT slug, max(replay) AS v FROM r GROUP BY 1), b AS (SELECT sid, max(replay) AS v FROM r GROUP BY 1)
SELECT o.o_orderkey AS slug, coalesce(a.v, b.v) AS replay, o.o_orderkey % 5 = 0 AS archived FROM orders o LEFT JOIN a ON a.slug = o.o_orderkey LEFT JOIN b ON b.sid = o.o_custkey""")
def catalogue_sources(t):
    rows = t("orders").select(F.col("o_orderkey").alias("slug"), F.col("o_custkey").alias("session"))
    replays = rows.where("slug % 3 = 0").withColumn("replay", F.col("slug"))
    return insights.sources(rows, replays, rows.where("slug % 5 = 0").select("slug")).select("slug", "replay", "archived")


# --- scenes -----------------------------------------------------------------------------------------------------

_KIND = "CASE event_type WHEN 'click' THEN 'user-prompt' WHEN 'signup' THEN 'text-response' ELSE 'tool-call' END"
_TOOL = "CASE event_type WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Edit' WHEN 'error' THEN 'Bash' END"
_FILE = "concat('/src/f', event_id % 9)"
_RESULT = "CASE WHEN event_id % 5 = 0 THEN '1 failed' WHEN event_id % 35 = 1 THEN 'All 3 passed' ELSE 'ok' END"
_COMMAND = "CASE WHEN event_id % 3 = 0 THEN 'pytest -q' WHEN event_id % 3 = 1 THEN 'git status' ELSE 'ls' END"
E = (
    f"e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS scene_index, {_KIND} AS type, {_TOOL} AS tool_name, {_FILE} AS file, {_COMMAND} AS command, props AS content, event_id FROM events), "
    "tt AS (SELECT *, sum(CASE WHEN type = 'user-prompt' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY scene_index) AS turn FROM e)"
)


def scene_rows(t):
    """Events in the shape of ``sessions.scenes``."""
    e = t("events")
    text, tool = F.expr(_KIND) != "tool-call", F.expr(_TOOL)
    diff = F.struct(F.expr(_FILE).alias("file_path"), F.lit("a").alias("old_content"), F.lit("a\nb\nc").alias("new_content"))
    return e.select(
        F.col("user_id").alias("session"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("scene_index"), F.expr(_KIND).alias("type"), F.when(text, F.col("props")).alias("content"), tool.alias("tool_name"),
        F.when(tool == "Read", F.create_map(F.lit("file_path"), F.expr(_FILE))).alias("input"), F.when(~text, F.expr(_RESULT)).alias("result"), F.when(~text, F.col("event_id") % 5 == 0).alias("is_error"),
        F.when(tool == "Edit", diff).alias("diff"), F.when(tool == "Bash", F.struct(F.expr(_COMMAND).alias("command"), F.lit("ok").alias("stdout"))).alias("bash"), F.array().cast("array<string>").alias("images"),
    )


@query(
    f"WITH {E} SELECT session, count(*) AS scenes, coalesce(sum(length(content)) FILTER (type = 'user-prompt'), 0)::BIGINT AS prompt_chars, 0::BIGINT AS thinking_chars, coalesce(sum(length(content)) FILTER (type = 'text-response'), 0)::BIGINT AS response_chars, "
    "count(*) FILTER (type = 'tool-call') AS tools, count(*) FILTER (tool_name = 'Bash' AND event_id % 5 = 0) AS errors, 0::BIGINT AS images FROM e GROUP BY 1"
)
def scene_totals(t):
    return scene_stats.totals(scene_rows(t))


@query(f"WITH {E} SELECT session, count(*) FILTER (tool_name = 'Read') AS reading, count(*) FILTER (tool_name = 'Edit') AS writing, count(*) FILTER (tool_name = 'Bash') AS running, 0::BIGINT AS other FROM e WHERE type = 'tool-call' GROUP BY 1")
def scene_activity(t):
    return scene_stats.activity(scene_rows(t))


@query(f"WITH {E} SELECT session, CASE command WHEN 'pytest -q' THEN 'test' WHEN 'git status' THEN 'git' ELSE 'other' END AS category, count(*) AS n FROM e WHERE tool_name = 'Bash' GROUP BY 1, 2")
def scene_commands(t):
    return scene_stats.commands(scene_rows(t))


@query(
    f"WITH {E}, n AS (SELECT session, count(*) AS total FROM e GROUP BY 1), g AS (SELECT session, total, b, b * total // 20 AS first, (b + 1) * total // 20 AS stop FROM n, generate_series(0, 19) x(b)), "
    "j AS (SELECT e.*, CASE WHEN g.total <= 20 THEN e.scene_index ELSE g.b END AS bucket, CASE type WHEN 'user-prompt' THEN 4 WHEN 'tool-call' THEN 3 ELSE 2 END AS r FROM e JOIN g ON g.session = e.session AND CASE WHEN g.total <= 20 THEN g.b = e.scene_index ELSE g.first <= e.scene_index AND e.scene_index < g.stop END) "
    "SELECT session, bucket::BIGINT AS bucket, arg_max(type, (r, -scene_index)) AS type, count(*) AS n FROM j GROUP BY 1, 2"
)
def scene_timeline(t):
    return scene_stats.timeline(scene_rows(t), 20)


@query(
    f"WITH {E} SELECT session, file, count(*) FILTER (tool_name = 'Read') AS reads, count(*) FILTER (tool_name = 'Edit') AS edits, 2 * count(*) FILTER (tool_name = 'Edit') AS added, 0::BIGINT AS removed FROM e WHERE tool_name IN ('Read', 'Edit') GROUP BY 1, 2"
)
def scene_files(t):
    return scene_stats.files(scene_rows(t))


@query(f"""
WITH {E}, c AS (SELECT session, file, turn, count(*) AS n FROM tt WHERE turn > 0 AND tool_name = 'Edit' GROUP BY 1, 2, 3), f AS (SELECT session, file, row_number() OVER (PARTITION BY session ORDER BY sum(n) DESC, file) AS rn FROM c GROUP BY 1, 2),
l AS (SELECT session, max(turn) AS last FROM tt WHERE turn > 0 GROUP BY 1), g AS (SELECT session, unnest(generate_series(greatest(last::BIGINT - 4, 1), last::BIGINT)) AS turn FROM l)
SELECT f.session, f.file, g.turn::BIGINT AS turn, coalesce(c.n, 0) AS edits FROM f JOIN g ON g.session = f.session LEFT JOIN c ON c.session = f.session AND c.file = f.file AND c.turn = g.turn WHERE rn <= 3""")
def scene_grid(t):
    return scene_stats.file_grid(scene_rows(t), 3, 5)


@query(
    f"WITH {E} SELECT session, turn::BIGINT AS turn, count(*) FILTER (type = 'tool-call') AS tools, coalesce(string_agg(DISTINCT tool_name, ',' ORDER BY tool_name), '') AS tool_names, count(*) FILTER (type = 'text-response') AS texts, min(scene_index)::BIGINT AS first_index, max(scene_index)::BIGINT AS end_index FROM tt WHERE turn > 0 GROUP BY 1, 2"
)
def scene_turns(t):
    return sessions.turn_stats(scene_rows(t)).select("session", "turn", "tools", F.array_join("tool_names", ",").alias("tool_names"), "texts", "first_index", "end_index")


@query(f"""
WITH {E}, a AS (SELECT session, concat('`', substr(file, 2), '` modified ', count(*), 'x') AS risk FROM e WHERE tool_name = 'Edit' GROUP BY session, file HAVING count(*) >= 4),
b AS (SELECT session, count(*) FILTER (event_id % 5 = 0) AS failed, count(*) FILTER (event_id % 35 = 1) AS passed FROM e WHERE tool_name = 'Bash' AND command = 'pytest -q' GROUP BY 1)
SELECT * FROM a UNION ALL SELECT session, concat(failed, ' test failure(s)', CASE WHEN passed > 0 THEN ' (resolved)' ELSE '' END) AS risk FROM b WHERE failed > 0""")
def scene_risks(t):
    return export.risks(scene_rows(t))


@query(
    f"WITH {E}, w AS (SELECT session, tool_name AS tool, CASE WHEN tool_name = 'Bash' THEN string_split(command, ' ')[1] END AS word, count(*) AS n, min(scene_index) AS first FROM e WHERE type = 'tool-call' GROUP BY 1, 2, 3) "
    "SELECT session, tool, sum(n)::BIGINT AS n, coalesce(string_agg(word, ',' ORDER BY first), '') AS commands FROM w GROUP BY 1, 2"
)
def scene_tools(t):
    return export.tool_counts(scene_rows(t), ["session"]).select("session", "tool", "n", F.array_join("commands", ",").alias("commands"))


@query(f"""
WITH {E} SELECT session, arg_min(content, scene_index) FILTER (type = 'user-prompt') AS prompt, count(*) FILTER (turn = 1 AND type = 'tool-call') AS tools, arg_max(content, scene_index) FILTER (type = 'text-response' AND length(content) > 10) AS last_response FROM tt GROUP BY 1""")
def scene_first_turn(t):
    return scene_stats.first_turn(scene_rows(t))


# --- tables kept up to date --------------------------------------------------------------------------------------


@query("SELECT user_id, value FROM (SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) WHERE last <> 'error'")
def current_entries(t):
    log = t("events").select("user_id", F.struct("ts", "event_id").alias("at"), "value", (F.col("event_type") == "error").alias("deleted"))
    return incremental.current(log, ["user_id"], "at").select("user_id", "value")


@query("WITH v AS (SELECT user_id AS k, count(*) AS n, max(ts) AS at FROM events WHERE event_type = 'view' GROUP BY 1) SELECT c_custkey AS k, c_custkey % 10 + coalesce(n, 0) AS view_count, v.at AS last_viewed_at FROM customer LEFT JOIN v ON k = c_custkey")
def view_counters(t):
    totals = t("customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 10).alias("view_count"), F.lit(None).cast("timestamp_ntz").alias("last_viewed_at"))
    return incremental.counters(totals, t("events").where("event_type = 'view'").select(F.col("user_id").alias("k"), F.col("ts").alias("viewed_at")), "k").select("k", "view_count", "last_viewed_at")


@query(f"WITH {E}, a AS (SELECT l_orderkey % 50 AS session, l_linenumber AS scene_index, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT e.session, e.scene_index::BIGINT AS scene_index, coalesce(n, 0) AS annotations FROM e LEFT JOIN a USING (session, scene_index)")
def annotation_counts(t):
    notes = t("lineitem").select((F.col("l_orderkey") % 50).alias("session"), F.col("l_linenumber").alias("scene_index"))
    return incremental.annotated(scene_rows(t).select("session", "scene_index"), notes).select("session", F.col("scene_index").cast("long").alias("scene_index"), "annotations")


_SHARED = "CASE WHEN o_orderkey % 3 = 0 THEN 'public' ELSE 'private' END"
_ENDS = "CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END"


@query(f"SELECT o_orderkey FROM orders WHERE {_SHARED} = 'public' AND ({_ENDS} IS NULL OR {_ENDS} > TIMESTAMP '1997-01-01')")
def public_rows(t):
    rows = t("orders").select("o_orderkey", F.expr(_SHARED).alias("visibility"), F.expr(_ENDS).alias("expires_at"))
    return incremental.public(rows, "1997-01-01").select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE {_ENDS} IS NULL OR {_ENDS} >= TIMESTAMP '1997-01-01' - INTERVAL 7 DAY")
def unexpired_rows(t):
    rows = t("orders").select("o_orderkey", F.expr(_ENDS).alias("expires_at"))
    return incremental.unexpired(rows, "1997-01-01").select("o_orderkey")


# --- the catalogue -------------------------------------------------------------------------------------------------

_CARD = {
    "session": "cast(o_orderkey as string)", "slug": "concat('s', o_orderkey)", "project": "concat('p', o_custkey)", "provider": "o_orderstatus", "title": "case when o_orderkey % 9 = 0 then null when o_orderkey % 9 = 1 then '<noise>' else concat('About ', o_orderpriority) end",
    "first_prompt": "concat('Order ', o_orderkey)", "prompt_count": "o_orderkey % 5", "model": "case when o_orderkey % 17 = 0 then null else 'm' end", "git_branch": "case when o_orderkey % 3 = 0 then 'main' when o_orderkey % 3 = 1 then o_orderpriority end", "modified": "o_orderdate",
}
C = "c AS (SELECT " + ", ".join(f"{v} AS {n}" for n, v in _CARD.items()).replace("as string", "AS VARCHAR") + ", o_orderkey AS k FROM orders), r AS (SELECT slug, k % 7 AS prompt_count FROM c WHERE k % 4 = 0)"


def cards(t):
    return t("orders").select(*(F.expr(v).alias(n) for n, v in _CARD.items()))


def replay_rows(t):
    return t("orders").where("o_orderkey % 4 = 0").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("slug"), (F.col("o_orderkey") % 7).alias("prompt_count"))


@query(f"WITH {C} SELECT session FROM c WHERE project <> '' AND (contains(lower(title), 'high') OR contains(lower(first_prompt), 'high') OR contains(slug, 'high') OR contains(lower(git_branch), 'high'))")
def catalogue_search(t):
    return catalogue.find_sessions(cards(t), "HIGH").select("session")


@query(f"WITH {C} SELECT project, count(*) AS sessions, max(modified) AS newest FROM c GROUP BY 1")
def catalogue_groups(t):
    return catalogue.grouped(cards(t))


@query(f"""
WITH {C}, b AS (SELECT *, CASE WHEN k % 5 > 0 THEN k % 5 END AS prompts, CASE WHEN k % 7 > 0 THEN 1 END AS tools, CASE WHEN k % 19 = 0 THEN ' <p> ' ELSE first_prompt END AS said FROM c WHERE provider = 'F' AND k % 4 > 0),
l AS (SELECT * FROM b WHERE prompts IS NULL OR tools IS NULL OR title IS NULL OR title LIKE '<%' OR model IS NULL OR k % 19 = 0),
i AS (SELECT c.session, c.modified FROM l JOIN c ON c.session = l.session WHERE c.k % 2 = 0), u AS (SELECT c.session, c.modified FROM l JOIN c ON c.k + 1 = l.k AND c.provider = 'F' WHERE l.k % 2 = 1 AND c.k % 2 = 0)
SELECT session, modified FROM (SELECT * FROM i UNION ALL SELECT * FROM u) ORDER BY modified DESC, session LIMIT 30""")
def catalogue_enrich(t):
    some = cards(t).withColumn("k", F.col("session").cast("long"))
    known = some.where("k % 2 = 0")
    # a card with an odd number has the project and slug of the known session before it, but another id
    before = known.select((F.col("k") + 1).alias("k"), F.col("project").alias("__p"), F.col("slug").alias("__s"))
    base = some.join(before, "k", "left").withColumn("project", F.coalesce("__p", "project")).withColumn("slug", F.coalesce("__s", "slug"))
    base = base.withColumn("prompt_count", F.when(F.col("k") % 5 > 0, F.col("k") % 5)).withColumn("tool_call_count", F.when(F.col("k") % 7 > 0, 1))
    base = base.withColumn("first_prompt", F.when(F.col("k") % 19 == 0, " <p> ").otherwise(F.col("first_prompt"))).withColumn("readable", F.col("k") % 4 > 0)
    return catalogue.to_enrich(base, known, "F").select("session", "modified")


@query(f"WITH {C} SELECT project, count(*) AS sessions, count(r.slug) AS replays FROM c LEFT JOIN r USING (slug) GROUP BY 1")
def catalogue_projects(t):
    return catalogue.project_counts(cards(t), replay_rows(t))


@query(f"WITH {C} SELECT count(*) AS sessions, count(DISTINCT project) AS projects, count(DISTINCT provider) AS providers, sum(greatest(c.prompt_count, coalesce(r.prompt_count, 0)))::BIGINT AS prompts, count(r.slug) AS replays, round(100.0 * count(r.slug) / count(*)) AS converted_percent FROM c LEFT JOIN r USING (slug)")
def catalogue_home(t):
    return catalogue.home(cards(t), replay_rows(t))


@query(f"""
WITH {C}, d AS (SELECT modified::DATE AS day, count(*) AS n, sum(prompt_count) AS p FROM c GROUP BY 1)
SELECT arg_max(day, (n, -date_diff('day', DATE '1970-01-01', day))) AS peak_day, max(n) AS peak, count(*) AS active_days, round(avg(n), 6) AS per_day, round(sum(p) / sum(n), 6) AS prompts_per_session FROM d""")
def catalogue_days(t):
    return catalogue.days(cards(t))


@query(f"""
WITH {C}, d AS (SELECT greatest(0, floor(2000.25 - (epoch_ms(TIMESTAMP '{TODAY} 13:00:00') - epoch_ms(modified)) / 86400000.0))::BIGINT AS days FROM c WHERE provider = 'F')
SELECT count(*) AS expiring, min(days) AS soonest FROM d WHERE days <= 7""")
def catalogue_expiring(t):
    return catalogue.expiring(cards(t), "F", f"{TODAY} 13:00:00", 2000.25)


@query("SELECT o_custkey AS owner, sum(round(o_totalprice))::BIGINT AS bytes FROM orders GROUP BY 1 HAVING sum(round(o_totalprice)) + 100000 <= 2000000")
def catalogue_quota(t):
    return catalogue.within_quota(t("orders").select(F.col("o_custkey").alias("owner"), F.round("o_totalprice").cast("long").alias("size")), 100_000, 2_000_000)


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR (o_orderkey % 3 > 0 AND (o_orderkey % 5 = 0 OR o_orderdate > TIMESTAMP '1997-01-01'))")
def catalogue_visible(t):
    rows = t("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("owner"), F.when(F.col("o_orderkey") % 3 == 0, "private").otherwise("unlisted").alias("visibility"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")).alias("expires_at"))
    return catalogue.visible(rows, "7", "1997-01-01").select("o_orderkey")


@query(f"WITH {C} SELECT session, coalesce(git_branch NOT IN ('main', 'master', ''), false) AS own FROM c")
def catalogue_branches(t):
    return cards(t).select("session", catalogue.own_branch().alias("own"))


@query(f"WITH {E} SELECT type, count(*) AS n FROM e WHERE type = 'user-prompt' GROUP BY 1")
def scene_prompts_only(t):
    return catalogue.shown(scene_rows(t), prompts_only=True).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""
WITH a AS (SELECT * FROM conversations WHERE role = 'assistant'), {clean_sql("a")}, p AS (SELECT conv_id AS session, turn, substr(prompt, 1, 12) AS p FROM cleaned),
k0 AS (SELECT session, p, min(turn) AS turn FROM p WHERE length(p) >= 8 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) AS rn FROM k0)
SELECT session, string_agg(p, '|' ORDER BY turn) AS previews FROM k WHERE rn <= 3 GROUP BY 1""")
def prompt_previews(t):
    said = t("conversations").where("role = 'assistant'").select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), "text")
    return catalogue.previews(said, limit=12).select("session", F.array_join("previews", "|").alias("previews"))


@query(f"WITH {E}, o AS (SELECT session, turn, min(scene_index) AS first FROM tt WHERE turn > 0 GROUP BY 1, 2) SELECT e.session, e.scene_index::BIGINT AS position, max(o.turn)::BIGINT AS turn FROM e LEFT JOIN o ON o.session = e.session AND o.first <= e.scene_index GROUP BY 1, 2")
def outline_positions(t):
    scene = scene_rows(t)
    out = catalogue.outline_position(sessions.turn_stats(scene), scene.select("session", F.col("scene_index").alias("position")))
    return out.select("session", F.col("position").cast("long").alias("position"), "turn")


# --- conversations of the second provider --------------------------------------------------------------------------

_INTENT = r"(?i)\b(?:I\s+need|I\s+think|I\s+should|I\s+might|I\s+could|I'm|I\s+am|I'll|I\s+will|let's|we\s+need\s+to|we\s+should)\b"


@query(f"""
WITH d AS (SELECT doc_id, doc_id % 3 AS m, regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '') AS body FROM documents)
SELECT doc_id, md5(CASE WHEN m < 2 AND regexp_matches(substr(body, 1, 500), '{_INTENT.replace("'", "''")}') THEN 'Did it.' ELSE 'Did it.' || chr(10) || chr(10) || (CASE m WHEN 0 THEN '**Planning**' WHEN 1 THEN '**Checking the rest**' ELSE '**Results**' END) || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END END) AS digest FROM d""")
def plans_removed(t):
    heading = F.expr("case doc_id % 3 when 0 then 'Planning' when 1 then 'Checking the rest' else 'Results' end")
    said = F.concat(F.lit("Did it.\n\n**"), heading, F.lit("**\n\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+", ""))
    return t("documents").select("doc_id", F.md5(composer.without_plan(said)).alias("digest"))


@query("""
SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN 'z' ELSE o_orderpriority END AS branch,
  o_orderstatus || '|x|' || o_orderpriority || CASE WHEN o_orderkey % 3 = 1 THEN '|z' ELSE '' END AS chain,
  CASE WHEN o_orderkey % 3 = 0 THEN 'x|' || o_orderpriority || '|' || o_orderstatus ELSE o_orderstatus || '|x|' || o_orderpriority || CASE WHEN o_orderkey % 3 = 1 THEN '|z' ELSE '' END END AS shown
FROM orders""")
def branch_chains(t):
    listed = F.array(F.struct(F.col("o_orderpriority").alias("branchName"), F.lit(None).cast("string").alias("branch"), F.lit(2).alias("lastInteractionAt")), F.struct(F.lit(None).cast("string").alias("branchName"), F.lit("x").alias("branch"), F.lit(1).alias("lastInteractionAt")))
    active = F.expr("case o_orderkey % 3 when 0 then o_orderstatus when 1 then 'z' end")
    json = F.to_json(F.struct(F.col("o_orderstatus").alias("createdOnBranch"), listed.alias("branches"), active.alias("activeBranch")))
    rows = t("orders").select(F.col("o_orderkey").alias("k"), composer.branches(json).alias("b")).select("k", "b.*")
    rows = rows.withColumn("shown", F.array_join(composer.branch_chain(F.col("branch"), F.col("chain")), "|"))
    return rows.withColumn("chain", F.array_join("chain", "|"))


@query("""
WITH e AS (SELECT l_orderkey AS k, l_linenumber AS n, unnest([0, 1]) AS place, unnest(['/d/p ' || l_partkey || '.py', 's' || l_suppkey]) AS file FROM lineitem),
f AS (SELECT k, file, min(n * 2 + place) AS o FROM e GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, file) AS rn FROM f)
SELECT k, string_agg(file, '|' ORDER BY o, file) AS files, (k % 2 = 0)::BIGINT AS request_contexts, k % 2 = 0 AS has_rules FROM g WHERE rn <= 3 GROUP BY k""")
def context_files(t):
    item = F.format_string('{"relevantFiles": ["file:///d/p%%20%d.py", {"path": "s%d"}]}', F.col("l_partkey"), F.col("l_suppkey"))
    bubbles = t("lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("position"), item.alias("bubble"))
    requests = bubbles.select("session").distinct().select("session", F.lit(0).alias("position"), F.when(F.col("session") % 2 == 0, '{"cursorRules": [{}]}').otherwise('{"cursorRules": []}').alias("request"))
    out = composer.context(bubbles, requests, 3)
    return out.select(F.col("session").alias("k"), F.array_join("context_files", "|").alias("files"), "request_contexts", "has_rules")


@query("""
WITH r AS (SELECT o_orderkey AS k, o_custkey % 20 AS u, o_orderkey % 7 AS m FROM orders)
SELECT k, CASE WHEN m = 5 THEN '/data/p5' ELSE '/home/u' || u || '/p' || m || CASE WHEN u < 3 AND m < 5 THEN '/sub' ELSE '' END END AS project FROM r""")
def project_roots(t):
    raw = F.format_string('{"file": "file:///home/u%d/p%d/sub/f.py"}', F.col("o_custkey") % 20, F.col("o_orderkey") % 7)
    rows = t("orders").select(F.col("o_orderkey").alias("session"), raw.alias("raw"))
    some = rows.sparkSession.range(50).select(F.format_string("/home/u%d/p%d", (F.col("id") / 5).cast("int"), F.col("id") % 5).alias("path"), "id")
    known = some.select("path").unionByName(some.where("id < 15").select(F.concat("path", F.lit("/sub")).alias("path"))).unionByName(some.where("id = 0").select(F.lit("/data/p5").alias("path")))
    return composer.with_project(rows, known).select(F.col("session").alias("k"), "project")
