"""Queries over the driver's tables, each with the SQL that must give the same rows.

The tables stand in for session logs: events of a user for a session, orders for sessions of a customer's project,
order lines for edits of part files, conversations for turns. "Now" is a constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions import blocks, pricing, redact, text
from tracewell.operators import joins, windows

NOW = "2024-01-31"
QUERIES = {}
ORACLE_SQL = {}


def cents():
    """Money in whole cents adds up to the same sum in any order."""
    return F.round(F.col("o_totalprice") * 100).cast("long")


def query(sql: str | None = None):
    """Register a query function of (table reader) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- activity ---------------------------------------------------------------------------------------------------


@query("""
SELECT user_id, nullif(sum(CASE WHEN gap IS NOT NULL THEN least(gap, 300000) END), 0)::BIGINT AS active_ms FROM (
  SELECT user_id, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE ts IS NOT NULL
) GROUP BY user_id""")
def active_duration(t):
    return windows.active_duration(t("events"), "user_id", "ts")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def events_per_day(t):
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT day, n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, day LIMIT 1")
def peak_day(t):
    return events_per_day(t).orderBy(F.desc("n"), "day").limit(1)


@query("""
SELECT count(DISTINCT ts::DATE)::BIGINT AS active_days, count(*)::BIGINT AS total, round(count(*) / count(DISTINCT ts::DATE), 6) AS per_active_day FROM events""")
def active_days(t):
    days = F.count_distinct(F.to_date("ts"))
    return t("events").agg(days.alias("active_days"), F.count("*").alias("total"), F.round(F.count("*") / days, 6).alias("per_active_day"))


@query("""
SELECT d.dow, coalesce(e.n, 0)::BIGINT AS n FROM (SELECT unnest(generate_series(0, 6))::INTEGER AS dow) d
LEFT JOIN (SELECT dayofweek(ts)::INTEGER AS dow, count(*) AS n FROM events GROUP BY 1) e USING (dow)""")
def day_of_week(t):
    spark = t("events").sparkSession
    spine = spark.range(7).select(F.col("id").cast("int").alias("dow"))
    counts = t("events").groupBy((F.dayofweek("ts") - 1).alias("dow")).agg(F.count("*").alias("n"))
    return spine.join(counts, "dow", "left").select("dow", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
SELECT w.week, coalesce(e.n, 0)::BIGINT AS n FROM (
  SELECT (date_trunc('week', DATE '2024-01-31') - to_days(CAST(7 * i AS INTEGER)))::DATE AS week FROM generate_series(0, 11) g(i)) w
LEFT JOIN (SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n FROM events GROUP BY 1) e USING (week)""")
def weekly_trend(t):
    spark = t("events").sparkSession
    spine = spark.range(12).select(F.date_sub(F.to_date(F.date_trunc("week", F.lit(NOW).cast("date"))), (7 * F.col("id")).cast("int")).alias("week"))
    counts = t("events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"))
    return spine.join(counts, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH w AS (SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n FROM events GROUP BY 1)
SELECT round(sum(CASE WHEN week > DATE '2024-01-29' - 28 THEN n ELSE 0 END) / 4, 6) AS recent, round(sum(CASE WHEN week <= DATE '2024-01-29' - 28 AND week > DATE '2024-01-29' - 56 THEN n ELSE 0 END) / 4, 6) AS prior FROM w""")
def trend_change(t):
    weeks = t("events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"))
    last = F.lit("2024-01-29").cast("date")
    recent, prior = F.col("week") > F.date_sub(last, 28), (F.col("week") <= F.date_sub(last, 28)) & (F.col("week") > F.date_sub(last, 56))
    return weeks.agg(F.round(F.sum(F.when(recent, F.col("n")).otherwise(0)) / 4, 6).alias("recent"), F.round(F.sum(F.when(prior, F.col("n")).otherwise(0)) / 4, 6).alias("prior"))


@query("""
WITH s AS (SELECT (DATE '2024-01-31' - i::INTEGER) AS day FROM generate_series(0, 27) g(i)), c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1),
j AS (SELECT s.day, coalesce(n, 0)::BIGINT AS n FROM s LEFT JOIN c USING (day))
SELECT day, n, CASE WHEN n = 0 THEN 0 ELSE least(4, ceil(4.0 * n / greatest(max(n) OVER (), 1)))::INTEGER END AS level FROM j""")
def activity_heatmap(t):
    spark = t("events").sparkSession
    spine = spark.range(28).select(F.date_sub(F.lit(NOW).cast("date"), F.col("id").cast("int")).alias("day"))
    counts = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    grid = spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    top = F.max("n").over(W.partitionBy(F.lit(1)))  # 28 rows
    return grid.withColumn("level", F.when(F.col("n") == 0, 0).otherwise(F.least(F.lit(4), F.ceil(4.0 * F.col("n") / F.greatest(top, F.lit(1))))).cast("int"))


@query("""
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'click'),
g AS (SELECT user_id, d, d - (row_number() OVER (PARTITION BY user_id ORDER BY d))::INTEGER AS g FROM d),
r AS (SELECT user_id, count(*) AS n, min(d) AS s, max(d) AS e FROM g GROUP BY user_id, g)
SELECT user_id, max(n) AS longest, arg_min(s, (-n, s)) AS longest_start, coalesce(max(CASE WHEN e >= DATE '2024-01-30' THEN n END), 0) AS current FROM r GROUP BY user_id""")
def streaks(t):
    return windows.streaks(t("events").where("event_type = 'click'"), "user_id", "ts", NOW)


@query("""
WITH e AS (SELECT *, ts >= TIMESTAMP '2024-01-24' AS recent FROM events), s AS (SELECT count(DISTINCT user_id) AS a, count(DISTINCT CASE WHEN recent THEN user_id END) AS r, sum(value) AS v FROM e)
SELECT r AS users, round(v * r / a, 4) AS scaled_value FROM s""")
def range_stats(t):
    recent = F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")
    s = t("events").agg(F.count_distinct("user_id").alias("a"), F.count_distinct(F.when(recent, F.col("user_id"))).alias("users"), F.sum("value").alias("v"))
    return s.select("users", F.round(F.try_divide(F.col("v") * F.col("users"), "a"), 4).alias("scaled_value"))


# --- order within a session ---------------------------------------------------------------------------------------


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type IS NOT NULL AND event_type <> '')
WHERE p IS DISTINCT FROM event_type""")
def branch_chain(t):
    return windows.consecutive_dedup(t("events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("""
WITH e AS (SELECT user_id, event_type, ts, event_id, floor(value)::BIGINT AS tokens FROM events WHERE floor(value) <> 0),
l AS (SELECT *, lag(tokens) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM e)
SELECT user_id, event_type, sum(CASE WHEN p IS NULL OR tokens < p THEN tokens ELSE greatest(0, tokens - p) END)::BIGINT AS tokens FROM l GROUP BY 1, 2""")
def snapshot_delta(t):
    e = t("events").select("user_id", "event_type", "ts", "event_id", F.floor("value").alias("tokens"))
    return windows.snapshot_delta(e, ["user_id", "event_type"], ["ts", "event_id"], ["tokens"])


@query("""
SELECT event_id, gap_ms FROM (SELECT event_id, event_type, (epoch_us(ts) // 1000) - last_value((epoch_us(ts) // 1000) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_ms FROM events)
WHERE event_type = 'click' AND gap_ms > 120000""")
def idle_gaps(t):
    return windows.idle_gaps(t("events"), ["user_id"], ["ts", "event_id"], "ts", F.col("event_type") == "click").select("event_id", "gap_ms")


@query("""
SELECT event_id, value, next_context FROM (SELECT event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_context FROM events)
WHERE value > 0 AND next_context > 0 AND next_context < 0.5 * value""")
def context_drop(t):
    return windows.context_drops(t("events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "value", "next_context")


@query("""
SELECT c.event_id, arg_min(p.event_id, (p.ts, p.event_id)) AS next_event_id, min(p.ts) AS next_ts
FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts >= c.ts WHERE c.event_type = 'click' GROUP BY c.event_id""")
def asof_assign(t):
    e = t("events").select("user_id", "event_id", "ts", "event_type")
    hit = joins.asof_forward(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], "ts", "event_id")
    return hit.select("event_id", "next_event_id", "next_ts")


_ZIP = """
WITH c AS (SELECT user_id, event_id AS click_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click'),
v AS (SELECT user_id, event_id AS view_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'view')
SELECT user_id, k, click_id, view_id FROM c {} JOIN v USING (user_id, k)"""


def _zip(t, how):
    e = t("events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("vts"), F.col("event_id").alias("view_id"))
    out = joins.positional(clicks, views, ["user_id"], ["ts", "click_id"], ["vts", "view_id"], how)
    return out.select("user_id", F.col("k").cast("long").alias("k"), "click_id", "view_id")


@query(_ZIP.format("LEFT"))
def positional_zip(t):
    return _zip(t, "left")


@query(_ZIP.format("FULL"))
def positional_full_outer(t):
    return _zip(t, "full_outer")


_TURNS = "SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations"


def _turns(t):
    return t("conversations").withColumn("t", windows.turn_id(F.col("role") == "user", ["conv_id"], ["turn"]))


@query(f"SELECT conv_id, t::BIGINT AS turn_no, count(*) AS n_rows, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest FROM ({_TURNS}) WHERE t > 0 GROUP BY 1, 2")
def turn_stats(t):
    rows = _turns(t).where("t > 0").groupBy("conv_id", F.col("t").alias("turn_no"))
    return rows.agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"SELECT conv_id, t::BIGINT AS turn_no, count(DISTINCT role) AS roles, count(*) FILTER (role = 'assistant') AS replies, max(turn) AS end_index FROM ({_TURNS}) GROUP BY 1, 2")
def turn_outline(t):
    rows = _turns(t).groupBy("conv_id", F.col("t").alias("turn_no"))
    return rows.agg(F.count_distinct("role").alias("roles"), F.count_if(F.col("role") == "assistant").alias("replies"), F.max("turn").alias("end_index"))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS prompts, count(*) FILTER (role = 'assistant') AS replies FROM conversations GROUP BY 1")
def turn_prompts(t):
    return t("conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("prompts"), F.count_if(F.col("role") == "assistant").alias("replies"))


@query("SELECT conv_id, arg_min(text, turn) AS first_prompt FROM conversations WHERE role = 'user' AND length(text) >= 10 GROUP BY 1")
def first_prompt(t):
    return t("conversations").where("role = 'user' and length(text) >= 10").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_prompt"))


@query("SELECT conv_id, arg_max(text, turn) AS last_response FROM conversations WHERE role = 'assistant' AND length(text) > 10 GROUP BY 1")
def last_response(t):
    return t("conversations").where("role = 'assistant' and length(text) > 10").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_response"))


@query("""
WITH c AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
SELECT conv_id, island::BIGINT AS island, role, count(*) AS n, min(turn) AS first_turn FROM i GROUP BY 1, 2, 3""")
def role_batches(t):
    runs = windows.islands(t("conversations"), ["conv_id"], ["turn"], "role")
    return runs.groupBy("conv_id", "island", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query(f"SELECT conv_id, t::BIGINT AS phase, count(*) AS n FROM ({_TURNS}) WHERE t >= 1 GROUP BY 1, 2")
def phase_extract(t):
    rows = windows.phases(t("conversations"), ["conv_id"], ["turn"], F.col("role") == "user", text.is_system_generated(F.col("text")))
    return rows.groupBy("conv_id", "phase").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_index,
min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_index FROM conversations""")
def prompt_nav(t):
    return windows.neighbours(t("conversations"), ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", "prev_index", "next_index")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- texts ------------------------------------------------------------------------------------------------------


def clean_sql(source: str) -> str:
    """Common table expressions that end in ``cleaned``: the rows of ``source`` with ``prompt``, its cleaned text."""
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    noise = " OR ".join(f"regexp_matches({strip('x')}, {_q(p)})" for p in text.TERMINAL_LINES)
    bare = "kept"
    for pattern, to in ((r"(?i)</?[a-z][^>]*>", ""), (r"(?m)^\s*\d+\|\s*", ""), (r"Caveat:\s*The messages below were generated by the user while running local commands\.[^.]*", ""), ("DO NOT respond to these messages[^.]*", ""), (r"^/\w+\s*", ""), (r"\s+", " ")):
        bare = f"regexp_replace({bare}, {_q(pattern)}, '{to}', 'g')"
    return rf"""w AS (SELECT *, {strip("coalesce(text, '')")} AS whole FROM {source}), l AS (SELECT *, string_split(whole, chr(10)) AS lines FROM w),
s AS (SELECT *, regexp_matches(lines[1], '^(?i)\S.*\[\d{{1,2}}:\d{{2}}\s?[ap]m\]$') AS speaker FROM l), g AS (SELECT *, CASE WHEN speaker THEN lines[2:] ELSE lines END AS rest FROM s),
h AS (SELECT *, CASE WHEN speaker AND regexp_matches({strip("coalesce(rest[1], '')")}, '^(?i)(?:hello|hi)\b') THEN rest[2:] ELSE rest END AS body FROM g),
f AS (SELECT *, {strip(f"array_to_string(list_filter(string_split({strip('array_to_string(body, chr(10))')}, chr(10)), lambda x: NOT ({noise})), chr(10))")} AS kept FROM h), b AS (SELECT *, {strip(bare)} AS bare FROM f),
cleaned AS (SELECT *, CASE WHEN regexp_matches(whole, {_q(text.SUMMARY)}) OR regexp_matches(kept, '(?i)<attached_files>|<code_selection\b') OR regexp_matches(bare, {_q(text.SUMMARY)}) OR (regexp_matches(whole, {_q(text.TERMINAL_NOISE)}) AND regexp_matches(bare, '^(?i)[a-z0-9._:-]{{1,12}}$')) THEN '' ELSE bare END AS prompt FROM b)"""


@query(f"WITH u AS (SELECT * FROM conversations WHERE role = 'user'), {clean_sql('u')} SELECT conv_id, turn, prompt FROM cleaned")
def clean_prompt(t):
    return t("conversations").where("role = 'user'").select("conv_id", "turn", text.clean_prompt(F.col("text")).alias("prompt"))


#: Noise that is put around texts, so that every step of the cleaning has work.
_NOISE = (
    "'Ann [9:05 am]' || chr(10) || 'Hello there' || chr(10) || text", "'Last login: today' || chr(10) || '➜  ~ git status' || chr(10) || text", "text || chr(10) || '- Token: abc' || chr(10) || 'user.name=x' || chr(10) || 'branch.main.remote=o'",
    "'  12| ' || text || chr(10) || ' 13| more'", "'Caveat: The messages below were generated by the user while running local commands. ' || text", "'/fix ' || '<b>' || text || '</b>'", "'<attached_files>' || text", "'Summary: 1. Primary request and intent: ' || text", "'github.com' || chr(10) || 'ok'", "text",
)


@query("WITH u AS (SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_NOISE)) + f" END AS text FROM documents), {clean_sql('u')} SELECT doc_id, prompt FROM cleaned")
def clean_noisy_prompt(t):
    noisy = F.expr("CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN {e.replace('chr(10)', 'char(10)')}" for i, e in enumerate(_NOISE)) + " END")
    return t("documents").select("doc_id", text.clean_prompt(noisy).alias("prompt"))


@query("SELECT doc_id, substr(text, 1, 200) AS title FROM documents WHERE text IS NOT NULL")
def title_select(t):
    return t("documents").where("text is not null").select("doc_id", F.substring("text", 1, 200).alias("title"))


@query("SELECT doc_id, substr(text, greatest(strpos(lower(text), 'tion') - 40, 1), 64 + strpos(lower(text), 'tion') - greatest(strpos(lower(text), 'tion') - 40, 1)) AS snippet FROM documents WHERE strpos(lower(text), 'tion') > 0 ORDER BY doc_id LIMIT 50")
def scene_search(t):
    hit = F.lower("text").contains("tion")
    return t("documents").where(hit).orderBy("doc_id").limit(50).select("doc_id", text.snippet(F.col("text"), "tion").alias("snippet"))



def _redact_sql(col: str) -> str:
    for pattern, before, mark, after in redact.steps():
        new = ("\\1" if before else "") + mark + ("\\1" if after else "")
        col = f"regexp_replace({col}, {_q(pattern)}, {_q(new)}, 'g')"
    return col


@query(f"SELECT doc_id, md5({_redact_sql('text')}) AS digest, length({_redact_sql('text')})::BIGINT AS n FROM documents")
def redact_text(t):
    clean = redact.redact(F.col("text"))
    return t("documents").select("doc_id", clean.alias("c")).select("doc_id", F.md5("c").alias("digest"), F.length("c").cast("long").alias("n"))


@query(f"SELECT page_id, md5({_redact_sql('html')}) AS digest FROM pages")
def redact_pages(t):
    return t("pages").select("page_id", F.md5(redact.redact(F.col("html"))).alias("digest"))


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS one FROM documents), f AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, unnest(regexp_extract_all(one, {_q(p)})) AS m FROM l" for r, p in redact.SCAN_RULES.items())
    + ") SELECT doc_id, rule, count(DISTINCT substr(m, 1, 30)) AS n FROM f WHERE NOT contains(m, '[REDACTED]') GROUP BY 1, 2"
)
def secret_scan(t):
    return redact.findings(t("documents"), "doc_id", "text").groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query(
    f"WITH c AS (SELECT doc_id, {_redact_sql('text')} AS t FROM documents) SELECT doc_id, length(t)::BIGINT AS n, "
    "substr(t, 1, 2000) || CASE WHEN length(t) > 2000 THEN chr(10) || '... (truncated, ' || length(t) || ' chars total)' ELSE '' END AS cut FROM c"
)
def truncate_redacted(t):
    clean = redact.redact(F.col("text"))
    return t("documents").select("doc_id", F.length(clean).cast("long").alias("n"), redact.truncate(F.col("text"), 2000).alias("cut"))


@query(ORACLE_SQL["truncate_redacted"])
def truncate_text(t):
    return truncate_redacted(t)


@query("SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents WHERE text IS NOT NULL GROUP BY 1")
def char_totals(t):
    docs = t("documents").where("text is not null")
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"))


@query("""
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), i AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations)
SELECT conv_id, (idx * 5 // n)::BIGINT AS bucket, arg_max(role, (CASE role WHEN 'user' THEN 3 WHEN 'system' THEN 2 ELSE 1 END)) AS kind, count(*) AS rows_in FROM i JOIN n USING (conv_id) GROUP BY 1, 2""")
def timeline_buckets(t):
    w = W.partitionBy("conv_id")
    rows = t("conversations").withColumn("idx", F.row_number().over(w.orderBy("turn")) - 1).withColumn("n", F.count("*").over(w))
    rank = F.when(F.col("role") == "user", 3).when(F.col("role") == "system", 2).otherwise(1)
    return rows.groupBy("conv_id", F.floor(F.col("idx") * 5 / F.col("n")).alias("bucket")).agg(F.max_by("role", rank).alias("kind"), F.count("*").alias("rows_in"))


@query(r"""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(event_type), '\b(view|signup)\b') THEN 'read' WHEN event_type = 'purchase' THEN 'write' WHEN event_type = 'error' THEN 'error' ELSE 'execute' END AS kind FROM events) GROUP BY 1""")
def tool_classify(t):
    kind = F.when(F.lower("event_type").rlike(r"\b(?:view|signup)\b"), "read").when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "error", "error").otherwise("execute")
    return t("events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_props(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


# --- usage and sessions -------------------------------------------------------------------------------------------


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def message_dedup_last(t):
    rows = t("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return joins.last_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_returnflag AS model, sum(l_quantity)::BIGINT AS input, sum(floor(l_extendedprice))::BIGINT AS output, count(*) AS messages FROM lineitem GROUP BY 1")
def usage_by_model(t):
    return t("lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.sum("l_quantity").cast("long").alias("input"), F.sum(F.floor("l_extendedprice")).alias("output"), F.count("*").alias("messages"))


@query("""
WITH m AS (SELECT CASE l_returnflag WHEN 'A' THEN 'x-opus-4-6' WHEN 'N' THEN 'haiku-4-5' ELSE 'other' END AS model, sum(l_quantity) AS i, sum(floor(l_extendedprice)) AS o FROM lineitem GROUP BY 1)
SELECT model, round((i * CASE model WHEN 'x-opus-4-6' THEN 5 WHEN 'haiku-4-5' THEN 1 ELSE 3 END + o * CASE model WHEN 'x-opus-4-6' THEN 25 WHEN 'haiku-4-5' THEN 5 ELSE 15 END) / 1000000, 4) AS cost FROM m""")
def cost_by_model(t):
    model = F.when(F.col("l_returnflag") == "A", "x-opus-4-6").when(F.col("l_returnflag") == "N", "haiku-4-5").otherwise("other")
    m = t("lineitem").groupBy(model.alias("model")).agg(F.sum("l_quantity").alias("i"), F.sum(F.floor("l_extendedprice")).alias("o"))
    return m.select("model", F.round(pricing.cost(F.col("model"), F.col("i"), F.col("o"), F.lit(0), F.lit(0)), 4).alias("cost"))


@query("""
SELECT o_orderkey AS session, any_value(o_custkey) AS project, count(l_linenumber) AS edits, count(DISTINCT l_partkey) AS files, coalesce(sum(l_quantity), 0)::BIGINT AS tokens, min(l_shipdate) AS start_time, max(l_shipdate) AS end_time
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def session_scan_row(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("edits"), F.count_distinct("l_partkey").alias("files"), F.sum("l_quantity").alias("tokens"), F.min("l_shipdate").alias("start_time"), F.max("l_shipdate").alias("end_time"))
    rows = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = F.lit(0)
    return rows.select(F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("project"), F.coalesce("edits", zero).alias("edits"), F.coalesce("files", zero).alias("files"), F.coalesce("tokens", zero).cast("long").alias("tokens"), "start_time", "end_time")


@query("""
SELECT o_custkey AS project, count(*) AS sessions, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, (sum(round(o_totalprice * 100)::BIGINT) // count(*))::BIGINT AS avg_cents, count(DISTINCT o_orderpriority) AS branches, max(o_orderdate) AS last_activity FROM orders GROUP BY 1""")
def project_insights(t):
    return t("orders").groupBy(F.col("o_custkey").alias("project")).agg(
        F.count("*").alias("sessions"), F.sum(cents()).alias("cents"), F.floor(F.sum(cents()) / F.count("*")).alias("avg_cents"), F.count_distinct("o_orderpriority").alias("branches"), F.max("o_orderdate").alias("last_activity")
    )


@query("""
SELECT count(*) AS sessions, count(DISTINCT o_custkey) AS projects, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, count(DISTINCT o_orderdate::DATE) AS active_days, count(DISTINCT (o_custkey, o_orderpriority)) AS branches FROM orders""")
def user_insights(t):
    return t("orders").agg(
        F.count("*").alias("sessions"), F.count_distinct("o_custkey").alias("projects"), F.sum(cents()).alias("cents"), F.count_distinct(F.to_date("o_orderdate")).alias("active_days"), F.count_distinct("o_custkey", "o_orderpriority").alias("branches")
    )


@query("SELECT l_partkey AS file, sum(l_quantity)::BIGINT AS edits, count(DISTINCT l_orderkey) AS sessions FROM lineitem GROUP BY 1 ORDER BY edits DESC, file LIMIT 20")
def hot_files(t):
    files = t("lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.sum("l_quantity").cast("long").alias("edits"), F.count_distinct("l_orderkey").alias("sessions"))
    return files.orderBy(F.desc("edits"), "file").limit(20)


@query("""
SELECT l_suppkey AS project, l_partkey AS file, n FROM (SELECT l_suppkey, l_partkey, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn <= 5""")
def files_modified_topk(t):
    counts = t("lineitem").groupBy(F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("file")).agg(F.count("*").alias("n"))
    return windows.top_k(counts, ["project"], [F.desc("n"), "file"], 5).select("project", "file", "n")


@query("SELECT o_custkey AS project, o_orderpriority AS branch, count(DISTINCT o_orderkey) AS sessions FROM orders GROUP BY 1, 2")
def branch_sessions(t):
    return t("orders").groupBy(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("branch")).agg(F.count_distinct("o_orderkey").alias("sessions"))


@query("""
SELECT r_name, n_name, count(*) AS customers, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def provider_breakdown(t):
    rows = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("customers")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    total = rows.agg(F.sum("customers").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("r_name", "n_name", "customers", F.round(100.0 * F.col("customers") / F.col("total"), 6).alias("share"))


@query("""
SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, count(*) AS parts, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1, 2""")
def merge_same_session(t):
    return t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count("*").alias("parts"), F.sum(cents()).alias("cents"))


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS rn FROM orders) WHERE rn <= 3")
def topk_per_group(t):
    return windows.top_k(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rn")


@query("""
SELECT o_orderpriority, count(*) AS n, coalesce(list_position(['3-MEDIUM', '1-URGENT', '5-LOW'], o_orderpriority), 100)::INTEGER AS place FROM orders GROUP BY 1 ORDER BY place, o_orderpriority""")
def custom_rank_sort(t):
    fixed = F.array(*(F.lit(x) for x in ("3-MEDIUM", "1-URGENT", "5-LOW")))
    place = F.coalesce(F.nullif(F.array_position(fixed, F.col("o_orderpriority")), F.lit(0)), F.lit(100)).cast("int")
    return t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / greatest(max(l_quantity) OVER (PARTITION BY l_orderkey), 1), 9) AS share FROM lineitem")
def ratio_to_max(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return windows.ratio_to_max(rows, ["l_orderkey"], "l_quantity", "share").select("l_orderkey", "l_linenumber", F.round("share", 9).alias("share"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS burned FROM lineitem")
def cumulative_burn(t):
    rows = windows.cumulative(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity", "burned")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("burned").cast("long").alias("burned"))


# --- joins and sets -----------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT o_orderkey AS slug, o_custkey AS sid, o_orderkey AS replay FROM orders WHERE o_orderkey % 3 = 0), a AS (SELECT slug, max(replay) AS v FROM r GROUP BY 1), b AS (SELECT sid, max(replay) AS v FROM r GROUP BY 1)
SELECT o.o_orderkey, coalesce(a.v, b.v) AS replay FROM orders o LEFT JOIN a ON a.slug = o.o_orderkey LEFT JOIN b ON b.sid = o.o_custkey""")
def source_replay_match(t):
    source = t("orders").select("o_orderkey", "o_custkey")
    replays = source.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("slug"), F.col("o_custkey").alias("sid"), F.col("o_orderkey").alias("replay"))
    return joins.preferred(source, replays, ("o_orderkey", "slug"), ("o_custkey", "sid"), "replay").select("o_orderkey", "replay")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def known_anti(t):
    return t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def archived_semi(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS present FROM customer")
def presence_mark(t):
    right = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.flagged(t("customer").select("c_custkey"), right, ["c_custkey"], "present")


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS n, NULL::DOUBLE AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k, coalesce(a.n, b.n) AS n, coalesce(a.v, b.v) AS v FROM a FULL JOIN b USING (k)""")
def enrich_coalesce(t):
    o = t("orders").withColumnRenamed("o_custkey", "k")
    a = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("v"))
    b = o.where("o_orderstatus = 'O'").groupBy("k").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("v"))
    return joins.coalesced(a, b, ["k"], ["n", "v"])


@query("""
WITH a AS (SELECT o_orderkey AS gist, o_totalprice AS views, 'legacy' AS origin FROM orders WHERE o_orderkey % 2 = 0 ORDER BY views DESC, gist LIMIT 50),
b AS (SELECT o_orderkey AS gist, o_totalprice AS views, 'cloud' AS origin FROM orders WHERE o_orderkey % 3 = 0 ORDER BY views DESC, gist LIMIT 50)
SELECT * FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE gist NOT IN (SELECT gist FROM b)) ORDER BY views DESC, gist LIMIT 50""")
def feed_union(t):
    rows = t("orders").select(F.col("o_orderkey").alias("gist"), F.col("o_totalprice").alias("views"))
    legacy, cloud = (rows.where(f"gist % {k} = 0").withColumn("origin", F.lit(n)) for k, n in ((2, "legacy"), (3, "cloud")))
    return joins.feed(legacy, cloud, "gist", [F.desc("views"), F.col("gist")], 50)


@query("SELECT o_orderkey AS slug, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS folder FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def first_wins_union(t):
    rows = t("orders").select(F.col("o_orderkey").alias("slug"))
    return joins.first_wins([rows.where(f"slug % {k} = 0").withColumn("folder", F.lit(n)) for k, n in ((2, "first"), (3, "second"))], "slug")


@query("SELECT o_custkey AS owner, sum(floor(o_totalprice))::BIGINT AS bytes FROM orders GROUP BY 1 HAVING sum(floor(o_totalprice)) + 100000 <= 2000000")
def storage_quota(t):
    used = t("orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.coalesce(F.sum(F.floor("o_totalprice")), F.lit(0)).alias("bytes"))
    return used.where(F.col("bytes") + 100_000 <= 2_000_000)


@query("SELECT count(*) AS expiring, min(greatest(0, 30 - date_diff('day', ts::DATE, DATE '2024-01-31')))::INTEGER AS soonest FROM events WHERE 30 - date_diff('day', ts::DATE, DATE '2024-01-31') <= 7")
def expiring(t):
    left = F.lit(30) - F.datediff(F.lit(NOW).cast("date"), F.to_date("ts"))
    return t("events").where(left <= 7).agg(F.count("*").alias("expiring"), F.min(F.greatest(F.lit(0), left)).alias("soonest"))


@query("""
SELECT count(*) AS docs, count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (d.n_chars < 100) AS short, round(100.0 * count(*) FILTER (l.doc_id IS NULL) / count(*), 4) AS percent FROM documents d LEFT JOIN labels l USING (doc_id)""")
def quality_notes(t):
    rows = t("documents").select("doc_id", "n_chars").join(t("labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    missing = F.count_if(F.col("has").isNull())
    return rows.agg(F.count("*").alias("docs"), missing.alias("unlabelled"), F.count_if(F.col("n_chars") < 100).alias("short"), F.round(100.0 * missing / F.count("*"), 4).alias("percent"))


@query("""
WITH e AS (SELECT user_id AS doc_id, ts, event_id, event_type FROM events WHERE event_type IN ('click', 'view')), l AS (SELECT doc_id, arg_max(event_type, (ts, event_id)) AS overlay FROM e GROUP BY 1)
SELECT d.doc_id, l.overlay FROM documents d LEFT JOIN l USING (doc_id)""")
def latest_overlay(t):
    edits = t("events").where("event_type in ('click', 'view')").groupBy(F.col("user_id").alias("doc_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("overlay"))
    return t("documents").select("doc_id").join(edits, "doc_id", "left")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) >= 4")
def risk_files(t):
    return t("orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 4")

@query(f"SELECT doc_id, regexp_replace(text, {_q(f'{redact.EMAIL[0]}({redact.EMAIL[1]})')}, '[REDACTED]\\1', 'g') AS clean FROM documents")
def email_redact(t):
    return t("documents").select("doc_id", F.regexp_replace("text", f"{redact.EMAIL[0]}({redact.EMAIL[1]})", r"\[REDACTED\]$1").alias("clean"))


@query(ORACLE_SQL["email_redact"])
def email_redact_all(t):
    return email_redact(t)


@query("""
WITH c AS (SELECT l_partkey AS file, l_linenumber AS turn, count(*) AS edits FROM lineitem GROUP BY 1, 2), f AS (SELECT file FROM c GROUP BY 1 ORDER BY sum(edits) DESC, file LIMIT 8), s AS (SELECT unnest(generate_series(1, 7))::INTEGER AS turn)
SELECT f.file, s.turn, coalesce(c.edits, 0)::BIGINT AS edits FROM f CROSS JOIN s LEFT JOIN c ON c.file = f.file AND c.turn = s.turn""")
def file_heatmap(t):
    cells = t("lineitem").groupBy(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("turn")).agg(F.count("*").alias("edits"))
    top = cells.groupBy("file").agg(F.sum("edits").alias("n")).orderBy(F.desc("n"), "file").limit(8)
    grid = top.select("file", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("turn"))
    return grid.join(cells, ["file", "turn"], "left").select("file", "turn", F.coalesce("edits", F.lit(0)).alias("edits"))


@query("SELECT l_orderkey, round(avg(CASE WHEN l_discount + l_tax > 0 THEN l_discount / (l_discount + l_tax) ELSE 0 END), 6) AS cache_share FROM lineitem GROUP BY 1")
def cache_ratio(t):
    share = F.coalesce(F.try_divide(F.col("l_discount"), F.col("l_discount") + F.col("l_tax")), F.lit(0.0))
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.avg(share), 6).alias("cache_share"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END::BIGINT AS n_lines FROM documents WHERE text IS NOT NULL")
def line_counts(t):
    return t("documents").where("text is not null").select("doc_id", blocks.line_count(F.col("text")).cast("long").alias("n_lines"))


@query("""
WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, CASE WHEN (epoch_us(ts) // 1000) - (epoch_us(p) // 1000) BETWEEN 1 AND 3599999 THEN (epoch_us(ts) // 1000) - (epoch_us(p) // 1000) END AS duration_ms FROM l""")
def tool_durations(t):
    e = t("events").withColumn("began", windows.last_result_start(F.col("ts"), F.lit(None).cast("timestamp_ntz"), ["user_id", "event_type"], ["ts", "event_id"]))
    took = windows.millis("ts") - windows.millis("began")
    return e.select("event_id", F.when((took > 0) & (took < 3_600_000), took).alias("duration_ms"))



def table_names() -> list[str]:
    return sorted(QUERIES)


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    return QUERIES[name](spark, sf_dir)


from tracewell.plans import log_queries, session_queries  # noqa: E402, F401  register their queries here
