import json
import os

import pytest
from pyspark.sql import functions as F

from tracewell.plans import registry
from tracewell.sources import transcripts as tr

LINES = [
    {"role": "user", "message": {"content": [{"type": "text", "text": "<user_info>\nos"}, {"type": "text", "text": "<user_query>\nfix it\n</user_query>"}]}},
    {"role": "assistant", "timestamp": "2025-01-01T00:00:00Z", "message": {"content": [{"type": "text", "text": "Looking.\n\n**Searching files**"}, {"type": "tool_use", "id": "t1", "name": "StrReplace", "input": {"path": "a.py", "oldStr": "x", "newStr": "y"}}]}},
    "no json",
    {"role": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "done"}], "is_error": True}]}},
    {"role": "assistant", "message": {"content": [{"type": "text", "text": "**Planning next**"}]}},
    {"role": "assistant", "message": {"content": "plain"}},
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("second")
    (root / "s1").mkdir()
    (root / "s1" / "s1.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in LINES))
    (root / "short.jsonl").write_text(json.dumps(LINES[0]))
    (root / "o1.txt").write_text("$ ls\na")
    (root / "o2.txt").write_text(" \n")
    os.utime(root / "o1.txt", (1000, 1000))
    return str(root)


def test_turns_outputs_and_scan(spark, root):
    rows = tr.entries(spark, root)
    turns = tr.turns(rows).where("session = 's1'")
    got = [(r["role"], r["kind"], r["text"], r["tool"], r["result"], r["is_error"]) for r in turns.orderBy("position").collect()]
    assert got == [
        ("user", "text", "fix it", None, None, False), ("assistant", "text", "Looking.", None, None, False), ("assistant", "marker", None, "Searching files", None, False),
        ("assistant", "tool", None, "StrReplace", "done", True), ("assistant", "marker", None, "Planning next", None, False),
    ]
    outputs = tr.tool_files(spark, root)
    assert [(r["id"], r["tool"], r["result"]) for r in outputs.collect()] == [("o1", "Bash", "$ ls\na")]
    full = tr.with_outputs(turns, outputs.withColumn("session", F.lit("s1")))
    got = [(r["kind"], r["tool"], r["text"], r["result"]) for r in full.orderBy("position").collect()]
    assert got[2] == ("tool", "Bash", None, "$ ls\na") and got[4] == ("thinking", None, "Planning next", None)
    surplus = tr.with_outputs(turns.where("kind <> 'marker'"), outputs.withColumn("session", F.lit("s1"))).orderBy("position").collect()
    assert (surplus[-1]["kind"], surplus[-1]["tool"]) == ("tool", "Bash")
    row = tr.scan(full).first()
    assert (row["first_prompt"], row["prompt_count"], row["tool_call_count"], row["edit_count"], row["files"]) == ("fix it", 1, 2, 1, ["a.py"])
    assert [(r["session"], r["lines"]) for r in tr.discover(spark, root).collect()] == [("s1", 6)]


def test_plans_and_images_go(spark, tmp_path):
    use = {"type": "tool_use", "id": "t", "name": "Read", "input": {}}
    lines = [
        {"role": "user", "message": {"content": [{"type": "text", "text": "look\n[Image]\n<image_files>\n1. /a.png\n</image_files>"}, {"type": "text", "text": "[image]"}]}},
        {"role": "assistant", "message": {"content": [{"type": "text", "text": "**Planning**\n\nI need more"}, use]}},
        {"role": "assistant", "message": {"content": [{"type": "text", "text": "**Planning**\n\nI need more"}]}},
        {"role": "assistant", "message": {"content": [{"type": "text", "text": "Done.\n\n**Next steps**\n\nLet's see"}]}},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = [(r["kind"], r["text"]) for r in tr.turns(tr.entries(spark, str(tmp_path))).orderBy("position").collect()]
    assert got == [("text", "look"), ("tool", None), ("text", "**Planning**\n\nI need more"), ("text", "Done.")]


def test_last_result_of_a_call_and_rows_of_a_session(spark, tmp_path):
    call = lambda i, name, **args: {"type": "tool_use", "id": i, "name": name, "input": args}
    done = lambda i, text, **more: {"type": "tool_result", "tool_use_id": i, "content": text, **more}
    lines = [
        {"role": "user", "timestamp": "2025-01-01T00:00:00Z", "message": {"content": [done("a", "early", is_error=True), {"type": "text", "text": "go"}, {"type": "text", "text": "on"}]}},
        {"role": "assistant", "timestamp": "2025-01-01T00:01:00Z", "message": {"content": [call("a", "StrReplace", path="x"), call("b", "StrReplace", path="y"), call("", "mcp__srv__t"), call("c", "StrReplace", path="y")]}},
        {"role": "user", "timestamp": "2025-01-01T01:00:00Z", "message": {"content": [done("a", "late"), done("b", "first"), done("b", "last"), done("", "none"), done("zz", "nobody's")]}},
        {"role": "assistant", "message": {"content": [{"type": "text", "text": "end"}]}},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    turns = tr.turns(tr.entries(spark, str(tmp_path)))
    got = [(r["position"], r["kind"], r["text"], r["tool_id"], r["result"], r["is_error"]) for r in turns.orderBy("position").collect()]
    assert got == [(0, "text", "go\non", None, None, False), (1, "tool", None, "a", "late", True), (2, "tool", None, "b", "last", False), (3, "tool", None, None, None, False), (4, "tool", None, "c", None, False), (5, "text", "end", None, None, False)]
    row = tr.session_rows(turns).first()
    assert (row["first_prompt"], row["prompt_count"], row["tool_call_count"], row["edit_count"], row["mcp_servers_used"], row["duration_ms"]) == ("go\non", 1, 4, 3, ["srv"], 60_000)
    assert [tuple(x) for x in row["files_modified"]] == [("y", 2), ("x", 1)]
    assert tr.session_rows(turns.where("tool_id is null")).first()["files_modified"] is None


def test_rows_of_transcripts_take_one_pass(spark):
    """lines are parsed once, and shuffled once by session, for all that a session's row holds."""
    plan = registry.QUERIES["transcript_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("FileScan"), plan.count("from_json(StructField(role"), plan.count("Exchange hashpartitioning(session")) == (1, 1, 1)


def test_coercions(spark):
    df = spark.createDataFrame([('{"inputTokens": 3.6, "output_tokens": "2", "cacheReadTokens": -5}',), ('{"inputTokens": 0}',), ("x",)], "j string")
    assert [r[0] and tuple(r[0]) for r in df.select(tr.token_usage(F.col("j"))).collect()] == [(4, 2, 0, 0), None, None]
    cases = {'{"isError": true}': True, '{"error": "no"}': True, '{"error": ""}': False, '{"rejected": false}': False, '[{"a": 1}, {"failure": {"x": 1}}]': True, '{"output": {"success": false}}': True, '{"output": {"success": {"a": 1}}}': False, "text": False}
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r["j"]: r["f"] for r in df.select("j", tr.failed(F.col("j")).alias("f")).collect()} == cases
    times = {'{"executionTime": "12"}': 12, '{"executionTimeMs": 0, "output": {"success": {"localExecutionTimeMs": 7.4}}}': 7, "{}": None}
    df = spark.createDataFrame([(k,) for k in times], "j string")
    assert {r["j"]: r["f"] for r in df.select("j", tr.execution_ms(F.col("j")).alias("f")).collect()} == times


def test_tool_arguments(spark):
    patch = "*** Begin Patch\n*** Update File: b.py\n@@\n keep\n-old\n+new\n*** End Patch"
    rows = [("StrReplace", '{"path": "a", "oldStr": "x", "new_string": "y"}'), ("ApplyPatch", patch), ("Shell", '{"command": "ls", "description": "d"}'), ("Other", "words"), ("Write", '{"file_path": "w", "contents": "c"}')]
    df = spark.createDataFrame(rows, "tool string, args string")
    got = {r["tool"]: r["a"] for r in df.select("tool", tr.tool_args(F.col("tool"), F.col("args")).alias("a")).collect()}
    assert tuple(got["StrReplace"])[:3] == ("a", "x", "y") and tuple(got["ApplyPatch"])[:3] == ("b.py", "keep\nold", "keep\nnew")
    assert (got["Shell"]["command"], got["Shell"]["description"]) == ("ls", "d") and got["Other"]["raw"] == "words" and got["Write"]["content"] == "c"


def test_thinking_of_a_transcript_fills_gaps(spark):
    schema = "session string, turn int, thinking array<string>"
    store = spark.createDataFrame([("s", 1, ["a"]), ("s", 4, [])], schema)
    text = spark.createDataFrame([("s", 0, ["a", "b"]), ("s", 1, ["c"]), ("s", 2, ["d"]), ("s", 3, [])], schema)
    got = [(r["added"], r["thinking"]) for r in tr.with_thinking(store, text).orderBy("turn").collect()]
    assert got == [(False, ["b", "a"]), (False, ["c"]), (True, ["d"])]
