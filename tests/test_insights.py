import sqlite3

import pytest

from tracewell.plans import export, incremental, insights, registry, session_queries
from tracewell.sources import stores
from tracewell.streaming import activity

ROW = (
    "session string, project string, provider string, start_time string, end_time string, duration_ms bigint, prompt_count bigint, tool_call_count bigint, edit_count bigint, sub_agent_count bigint, "
    "api_error_count bigint, compaction_count bigint, input_tokens bigint, output_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, cost double, model string, git_branch string, "
    "git_branches array<string>, pr_links array<struct<pr_number:bigint,pr_url:string,pr_repository:string>>, files_modified array<struct<file:string,count:bigint>>"
)


def row(session, project, day, ms, prompts, cost, branches, links, files, model="m"):
    start = f"2025-03-{day:02d}T10:00:00Z"
    return (session, project, "a", start, start, ms, prompts, 2, 1, 0, 0, 0, 10, 5, 0, 1, cost, model, branches[-1] if branches else None, branches if len(branches) > 1 else None, [(n, f"u{n}", "r") for n in links] or None, files)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            row("s1", "p", 3, 1000, 2, 0.5, ["main", "x"], [1], [("a", 2), ("b", 1)]),
            row("s2", "p", 4, None, 3, None, ["x"], [1, 2], [("a", 1)]),
            row("s3", "q", 4, 3000, 1, 1.0, [], [], []),
            row("s4", "q", 10, 2000, 0, 0.25, ["main"], [], [("c", 9)], None),
        ],
        ROW,
    )


def test_projects_and_user(rows):
    p = {r["project"]: r for r in insights.projects(rows).collect()}
    assert (p["p"]["sessions"], p["p"]["prompt_count"], p["p"]["avg_duration_ms"], p["p"]["branches"], p["p"]["pull_requests"], p["p"]["active_days"]) == (2, 5, 1000, 2, 2, 2)
    assert (p["q"]["avg_duration_ms"], p["q"]["cost"], p["q"]["branches"]) == (2500, 1.25, 1)
    u = insights.user(rows).first()
    assert (u["sessions"], u["projects"], u["duration_ms"], u["last_activity"]) == (4, 2, 6000, "2025-03-10T10:00:00Z")
    assert {(r["project"], r["branch"]): (r["sessions"], r["pull_requests"]) for r in insights.branches(rows).collect()} == {("p", "main"): (1, 0), ("p", "x"): (2, 2), ("q", "main"): (1, 0)}
    assert [(r["file"], r["edits"], r["sessions"]) for r in insights.hot_files(rows).where("project = 'p'").orderBy("rn").collect()] == [("a", 3, 2), ("b", 1, 1)]


def test_hot_files_dealt_to_tasks(spark):
    """entries dealt to a given number of tasks rank alike, also a file of most sessions, ties and a session's repeated files."""
    entries = [(f"s{i}", f"p{i % 3 and 1}", [("all", 1), (f"f{i % 30}", i % 4), (f"g{i % 50}", 2), ("twice", 1), ("twice", 1)]) for i in range(200)] + [("s0", "p0", [("all", 5)]), ("s1", None, [("x", 1)]), ("s2", "p1", [])]
    rows = spark.createDataFrame(entries, "session string, project string, files_modified array<struct<file:string,count:bigint>>")
    sums, of = {}, {}
    for session, project, files in entries:
        for file, count in files:
            sums[project, file] = sums.get((project, file), 0) + count
            of.setdefault((project, file), set()).add(session)
    want = []
    for project in ("p0", "p1", None):
        best = sorted((-n, f) for (p, f), n in sums.items() if p == project)[:5]
        want += [(project, f, -n, len(of[project, f]), k) for k, (n, f) in enumerate(best, 1)]
    for parts in (None, 7):
        got = insights.hot_files(rows, 5, parts)
        assert sorted(map(str, map(tuple, got.select("project", "file", "edits", "sessions", "rn").collect()))) == sorted(map(str, want))
    assert got.rdd.getNumPartitions() == 7


def test_tasks_grow_with_the_order_lines(spark, monkeypatch):
    """a task's share of the order lines stays, Spark doesn't put shares together."""
    monkeypatch.setattr(session_queries, "LINES_A_TASK", 100)
    path = "/root/testdata/sf0.001"
    tasks = -(-spark.read.parquet(f"{path}/lineitem.parquet").count() // 100)
    assert tasks > 16 and registry.QUERIES["session_hot_files"](spark, path).rdd.getNumPartitions() == tasks


def test_days_and_trends(rows):
    assert {r["dow"]: r["sessions"] for r in insights.weekdays(rows).collect()} == {0: 0, 1: 2, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0}
    assert sum(r["sessions"] for r in insights.weeks(rows, "2025-03-12").collect()) == 4
    t = insights.trend(rows, "2025-03-12", 1).first()
    assert (t["recent"], t["prior"]) == (1.0, 3.0) and t["change"] == pytest.approx(-2 / 3)
    grid = {str(r["day"]): r["level"] for r in insights.heatmap(rows, "2025-03-10", 2).collect()}
    assert len(grid) == 14 and (min(grid), max(grid)) == ("2025-03-02", "2025-03-15") and set(grid.values()) == {0, 2, 4}
    s = insights.streak(rows, "2025-03-11").first()
    assert (s["longest"], s["current"]) == (2, 1)
    assert insights.scaled(rows, "2025-03-10", 5).first()["prompt_count"] == pytest.approx(6 / 4)
    assert insights.in_range(rows, "2025-03-10", 5).count() == 1
    assert {r["model"]: r["share"] for r in insights.shares(rows, "model").collect()} == {"m": 0.75, None: 0.25}


def test_catalogue(spark):
    parts = spark.createDataFrame([("p", "a", 1, 10, "f1", 1, 2, "old", "s1"), ("p", "a", 2, 5, "f2", 3, 4, "new", "s2"), ("p", "b", 1, 1, "f3", 0, 0, "t", "s3")], "project string, slug string, modified int, size bigint, path string, prompts int, tool_calls int, title string, session string")
    one = insights.latest_of_parts(parts)
    got = {r["slug"]: (r["title"], r["size"], r["prompts"], r["paths"]) for r in one.collect()}
    assert got == {"a": ("new", 15, 4, ["f1", "f2"]), "b": ("t", 1, 0, ["f3"])}
    replays = spark.createDataFrame([("a", "zz", "r1"), ("zz", "s3", "r2")], "slug string, session string, replay string")
    archived = spark.createDataFrame([("b",)], "slug string")
    assert {r["slug"]: (r["replay"], r["archived"]) for r in insights.sources(one, replays, archived).collect()} == {"a": ("r1", False), "b": ("r2", True)}


def test_stores(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "state.db")
    db.execute("CREATE TABLE kv (key TEXT, value BLOB)")
    db.executemany(
        "INSERT INTO kv VALUES (?, ?)",
        [
            ("composerData:c1", '{"name":"n","createdAt":1700000000000,"fullConversationHeadersOnly":[{"bubbleId":"b2"},{"bubbleId":"b1"},{"bubbleId":"gone"}],"modelConfig":{"modelName":"x,y"}}'),
            ("composerData:c2", '{"name":"empty","fullConversationHeadersOnly":[]}'),
            ("bubbleId:c1:b1", '{"type":2,"text":"done","toolFormerData":{"name":"run_terminal_cmd","params":"{}","result":"ok"},"tokenCount":{"inputTokens":3}}'),
            ("bubbleId:c1:b2", '{"type":1,"text":"please"}'),
            ("other", "x"),
        ],
    )
    db.commit()
    db.close()
    (tmp_path / "broken.db").write_bytes(b"nothing")
    kv = stores.rows(spark, str(tmp_path), "kv")
    assert kv.count() == 5 and stores.rows(spark, str(tmp_path), "kv", prefix="bubbleId:").count() == 2 and stores.rows(spark, str(tmp_path), "none").count() == 0
    c = stores.composers(kv)
    assert [(r["composer"], r["model"], r["created"].year) for r in c.collect()] == [("c1", "y", 2023)]
    got = [(r["role"], r["text"], r["tool"], r["model"]) for r in stores.bubbles(kv, c).orderBy("position").collect()]
    assert got == [("user", "please", None, "y"), ("assistant", "done", "Bash", "y")]


def test_blobs(spark):
    a, b = bytes(range(32)), bytes(range(100, 132))
    root = b"\x01" + b"\x0a\x20" + a + b"\x0a\x20" + b
    meta = '{"agentId":"g","latestRootBlobId":"root","createdAt":1700000000000}'.encode().hex().encode()
    blobs = spark.createDataFrame([("f", "root", root), ("f", a.hex(), b'{"role":"user"}'), ("f", b.hex(), b"\x00binary")], stores.SCHEMA)
    metas = stores.meta(spark.createDataFrame([("f", "0", meta)], stores.SCHEMA))
    assert [(r["position"], r["message"]) for r in stores.messages(metas, blobs).collect()] == [(0, '{"role":"user"}')]


def test_incremental(spark):
    files = spark.createDataFrame([("s1", 1, 10), ("s1", 2, 5), ("s2", 1, 1)], "s string, t int, length bigint").selectExpr("s", "timestamp_seconds(t) AS modified", "length")
    now = incremental.fingerprints(files, files["s"], "v1")
    old = now.where("session = 's1'")
    assert [r["session"] for r in incremental.changed(now, old).collect()] == ["s2"]
    assert incremental.changed(incremental.fingerprints(files, files["s"], "v2"), now).count() == 2
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, incremental.upsert(a, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    log = spark.createDataFrame([(1, 1, "x", None), (1, 2, "y", None), (2, 1, "z", None), (2, 3, "z", True)], "k int, at int, v string, deleted boolean")
    assert [tuple(r) for r in incremental.current(log, ["k"], "at").collect()] == [(1, 2, "y")]
    cloud = spark.createDataFrame([("public", None), ("public", "2025-01-01"), ("private", None)], "visibility string, expires_at string")
    assert incremental.public(cloud, "2025-01-05").count() == 1 and incremental.unexpired(cloud, "2025-01-05").count() == 3 and incremental.unexpired(cloud, "2025-02-05").count() == 2


def test_markdown(spark):
    kind = "session string, scene_index int, type string, content string, tool_name string, result string, is_error boolean, bash struct<command:string,stdout:string>, diff struct<file_path:string,old_content:string,new_content:string>"
    edit = lambda k: ("s", k, "tool-call", None, "Edit", "", False, None, ("/p/src/a.py", "x", "y"))
    scenes = spark.createDataFrame(
        [("s", 0, "user-prompt", "Fix *it*", None, None, None, None, None), *(edit(k) for k in range(1, 5)), ("s", 5, "tool-call", None, "Bash", "1 failed", False, ("pytest -q", ""), None), ("s", 6, "text-response", "All is repaired now", None, None, None, None, None)],
        kind,
    )
    rows = spark.createDataFrame([("s", "m", 65000, 1, 5)], "session string, model string, duration_ms bigint, prompt_count bigint, tool_call_count bigint")
    text = export.markdown(scenes, rows).first()["markdown"]
    assert "1m 5s · 1 files changed · m" in text and "4 Edit, 1 Bash (pytest)" in text and r"> **Fix \*it\***" in text
    assert "> *All is repaired now*" in text and "modified 4x" in text and "- 1 test failure(s)" in text


def test_streams(spark, tmp_path):
    rows = [("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:01:00"), ("a", "2025-01-01 01:00:00"), ("b", "2025-01-02 00:00:00")]
    spark.createDataFrame(rows, "user string, at string").selectExpr("user", "timestamp(at) AS at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, at timestamp").parquet(str(tmp_path / "in"))
    q = activity.active_time(stream, "user", "at").writeStream.outputMode("update").format("memory").queryName("active").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    assert q.awaitTermination(120)
    assert {(r["user"], r["active_ms"]) for r in spark.table("active").collect()} == {("a", 60_000 + 300_000), ("b", 0)}
    q = activity.windowed_counts(stream, "at", ["user"]).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    assert q.awaitTermination(120)
    assert {(r["user"], r["n"]) for r in spark.table("days").collect()} == {("a", 3), ("b", 1)}
