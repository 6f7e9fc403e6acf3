import json

from pyspark.sql import functions as F

from tracewell.plans import catalogue


def test_kept_sessions_and_slugs(spark):
    df = spark.createDataFrame([("a", ["<b>hi</b>", "please mend the parser"]), ("b", ["<x>short</x>"]), (None, ["please mend the parser"]), ("c", None)], "session string, prompts array<string>")
    assert [r["session"] for r in catalogue.kept(df).collect()] == ["a"]
    slugs = {"a-b.c": True, "..": False, "a/b": False, ".hid": False, "a..b": False, None: False}
    df = spark.createDataFrame([(k,) for k in slugs], "s string")
    assert {r["s"]: r["ok"] for r in df.select("s", catalogue.safe_slug(F.col("s")).alias("ok")).collect()} == slugs


def test_orders_unions_and_scans(spark):
    a, b = spark.createDataFrame([("x", 1)], "session string, n int"), spark.createDataFrame([("y", "t")], "session string, title string")
    assert {tuple(r) for r in catalogue.all_providers([a, b]).collect()} == {("x", 1, None), ("y", None, "t")}
    p = spark.createDataFrame([("p", 2, 1.0), ("q", 3, None), ("r", 1, 5.0)], "project string, sessions int, cost double")
    assert [r["project"] for r in catalogue.ordered(p, "cost", "project").collect()] == ["r", "p", "q"]
    assert [r["project"] for r in catalogue.ordered(p, "sessions", "project").collect()] == ["q", "p", "r"]
    rows, scans = spark.createDataFrame([("s",), ("t",)], "slug string"), spark.createDataFrame([("s", 1, 5, 1), ("s", 2, 7, 2)], "slug string, at int, prompt_count int, tool_calls int")
    assert {r["slug"]: r["scanned_prompts"] for r in catalogue.with_scan(rows, scans).collect()} == {"s": 7, "t": None}
    notes = spark.createDataFrame([("p",), ("p",)], "project string")
    assert {r["project"]: r["notes"] for r in catalogue.with_notes(p, notes).collect()} == {"p": 2, "q": 0, "r": 0}
    tools = spark.createDataFrame([("View", ""), ("Write", None), ("Bash", "2 passed"), ("Bash", "Exit code 1, 2 passed"), ("Bash", "ok"), ("Glob", "error"), ("Task", ""), ("NotebookEdit", "")], "t string, r string")
    got = [tuple(r) for r in tools.select(catalogue.tool_action(F.col("t")), catalogue.run_passed(F.col("t"), F.col("r"))).collect()]
    assert got == [("read", None), ("create", None), ("run", True), ("run", False), ("run", None), ("search", None), (None, None), (None, None)]


def test_days_until_cleanup(spark):
    rows = spark.createDataFrame([("2025-03-01T12:00:00Z",), ("2025-03-01T12:00:01Z",), ("2025-01-01T00:00:00Z",), ("2025-03-11T12:00:00Z",), ("never",), (None,)], "at string")
    left = lambda period: [r[0] for r in rows.select(catalogue.days_left(F.col("at"), "2025-03-11T12:00:00Z", period)).collect()]
    assert left(30) == [20, 20, 0, 30, None, None] and left(10) == [0, 0, 0, 10, None, None]
    assert left(0) == left(-1) == [None] * 6
    cards = spark.createDataFrame([("a", "2025-02-14T00:00:00Z"), ("a", "2025-02-16T13:00:00Z"), ("a", "2025-03-01T00:00:00Z"), ("b", "2025-02-14T00:00:00Z")], "provider string, modified string")
    assert tuple(catalogue.expiring(cards, "a", "2025-03-11T12:00:00Z").first()) == (2, 4)


def test_uploads(spark):
    good = {"meta": {"sessionId": "s", "provider": "p", "title": "t" * 300, "model": "m", "stats": {"sceneCount": 2e9, "userPrompts": -4, "toolCalls": "7", "durationMs": 5.9, "costEstimate": 1.5}}, "scenes": [{"type": "thinking", "content": "x"}, {"type": "user-prompt", "content": "q" * 400}]}
    rows = [
        (json.dumps(good), None), ("not json", "Missing meta object"), ("{}", "Missing meta object"), ('{"meta": {}}', "Missing meta.sessionId"), ('{"meta": {"sessionId": 3}}', "Missing meta.sessionId"), ('{"meta": {"sessionId": "a"}}', "Missing meta.provider"),
        ('{"meta": {"sessionId": "a", "provider": "b"}, "scenes": 1}', "Missing scenes array"), ('{"meta": {"sessionId": "a", "provider": "b"}, "scenes": [{"type": "x"}, {"type": 1}]}', "Invalid scene at index 1: missing type"), ('{"meta": {"sessionId": "a", "provider": "b"}, "scenes": []}', None),
    ]
    df = spark.createDataFrame(rows, "document string, want string")
    got = df.select("want", catalogue.upload_error(F.col("document")).alias("error"), catalogue.upload_row(F.col("document")).alias("row")).collect()
    assert [r["error"] for r in got] == [r["want"] for r in got]
    assert tuple(got[0]["row"]) == ("t" * 200, "p", "m", 100_000, 0, 7, 5, "1.5", "q" * 300)
    assert tuple(got[1]["row"]) == ("Untitled", "claude-code", None, 0, 0, 0, 0, None, None)
