import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import blocks
from tracewell.plans import scene_stats, sessions
from tracewell.sources import logs

T = "2025-05-02T08:00:{:02d}Z"


def tool(id, name, **input):
    return {"type": "tool_use", "id": id, "name": name, "input": input}


def result(id, content, **more):
    return {"type": "tool_result", "tool_use_id": id, "content": content, **more}


def user(second, content, **more):
    return {"type": "user", "timestamp": T.format(second), "message": {"role": "user", "content": content}, **more}


def assistant(second, id, content, output=10, model="x-sonnet-4", **more):
    use = {"input_tokens": 100, "output_tokens": output, "cache_creation_input_tokens": 0, "cache_read_input_tokens": 7}
    return {"type": "assistant", "timestamp": T.format(second), "message": {"role": "assistant", "id": id, "model": model, "content": content, "usage": use, **more}}


LOG = [
    {"type": "file-history-snapshot", "snapshot": {"timestamp": "2025-05-02T07:59:00Z", "trackedFileBackups": {"/home/me/p/z.py": {"v": 1}, "/home/me/p/a.py": {}}}, "slug": "", "cwd": "/home/me/p", "gitBranch": "main", "entrypoint": "cli", "permissionMode": "plan"},
    user(1, "Please repair the parser in lib.py", gitBranch="main"),
    assistant(5, "m1", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "On it."}]),
    assistant(6, "m1", [tool("t1", "Edit", file_path="/home/me/p/lib.py", old_string="password=hunter2hunter2", new_string="b"), tool("t2", "Read", file_path="/home/me/p/a.py")], output=30) | {"gitBranch": "fix"},
    user(9, [result("t1", "done"), result("t2", [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}], is_error=True)]),
    "not json",
    "",
    user(20, "Base directory for this skill: /skills/tidy\nmore", isMeta=True),
    user(21, [{"type": "text", "text": "Now test"}, {"type": "image", "source": {"media_type": "image/png", "data": "QQ=="}}]),
    user(22, "<command-name>clear</command-name>"),
    assistant(23, "m2", [tool("t3", "Bash", command="pytest -q"), tool("t4", "mcp__git__log", n=1), tool("t5", "Write", file_path="/home/me/p/b.py", content="z")], model="<synthetic>"),
    user(29, [result("t3", "2 passed")]),
    assistant(30, "m3", [{"type": "text", "text": "cut off"}], stop_reason="max_tokens"),
    {"type": "pr-link", "data": {"prNumber": 4, "prUrl": "https://e.org/p/4", "prRepository": "e/p"}},
    {"type": "pr-link", "data": {"prNumber": 4, "prUrl": "https://e.org/p/4", "prRepository": "e/p"}},
    {"type": "system", "subtype": "turn_duration", "durationMs": 4000},
    {"type": "system", "subtype": "turn_duration", "durationMs": 5000},
    {"type": "system", "subtype": "compact_boundary"},
    {"type": "system", "subtype": "api_error", "error": {"status": 529}},
    {"type": "system", "subtype": "api_error", "retryAttempt": 2, "error": {"status": 529, "error": {"type": "error", "error": {"type": "overloaded_error", "message": "busy"}}}},
    {"type": "progress", "data": "tick"},
    {"type": "custom-title", "customTitle": "Parser"},
]
OTHER = [user(1, "A second session"), user(11, "with a gap"), user(12, "")]
AGENT = [
    assistant(7, "s1", [tool("u1", "Write", file_path="/home/me/p/lib.py", content="q")]),
    user(8, [result("u1", "wrote /home/me/p/lib.py with password=hunter2hunter2")]),
    assistant(9, "s2", [{"type": "text", "text": "token: abcdefghijkl " + "z" * 1100}]),
]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "one" / "subagents").mkdir(parents=True)
    for path, rows in ((root / "one.jsonl", LOG), (root / "two.jsonl", OTHER), (root / "one" / "subagents" / "agent-7.jsonl", AGENT)):
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return logs.events(spark, str(root))


def test_one_row_a_session(events):
    rows = {r["session"]: r for r in sessions.scan(events, home="/home/me").collect()}
    assert set(rows) == {"one", "two"}
    r = rows["one"]
    assert (r["prompt_count"], r["tool_call_count"], r["edit_count"], r["duration_ms"]) == (3, 5, 3, 9000)
    assert (r["compaction_count"], r["api_error_count"], r["sub_agent_count"]) == (1, 2, 1)
    assert (r["start_time"], r["end_time"]) == ("2025-05-02T07:59:00Z", T.format(30))
    assert (r["title"], r["model"], r["entrypoint"], r["permission_mode"]) == ("Parser", "x-sonnet-4", "cli", "plan")
    assert r["first_prompt"] == "Please repair the parser in lib.py"
    assert (r["git_branch"], r["git_branches"]) == ("fix", ["main", "fix"])
    assert [tuple(x) for x in r["files_modified"]] == [("~/p/lib.py", 2), ("~/p/b.py", 1)]
    assert (r["input_tokens"], r["output_tokens"], r["cache_read_input_tokens"]) == (300, 50, 21)
    assert r["cost"] == pytest.approx((200 * 3 + 40 * 15 + 14 * 0.3) / 1e6)
    assert r["skills_used"] == ["tidy"] and r["mcp_servers_used"] == ["git"]
    assert [tuple(x) for x in r["pr_links"]] == [(4, "https://e.org/p/4", "e/p")]
    assert (r["slug"], r["cwd"], r["tracked_files"]) == (None, "/home/me/p", ["~/p/a.py", "~/p/z.py"])
    r = rows["two"]
    assert (r["prompt_count"], r["duration_ms"], r["cost"], r["git_branch"], r["edit_count"]) == (3, 11000, None, None, 0)


def test_scenes_in_order_and_redacted(events):
    rows = sessions.scenes(events, home="/home/me").where("session = 'one'").orderBy("scene_index").collect()
    assert [r["type"] for r in rows] == ["user-prompt", "thinking", "text-response", "tool-call", "tool-call", "context-injection", "user-prompt", "tool-call", "tool-call", "tool-call", "text-response"]
    edit, read, bash = rows[3], rows[4], rows[7]
    assert edit["diff"]["file_path"] == "~/p/lib.py" and "hunter2" not in edit["diff"]["old_content"] and edit["diff"]["new_content"] == "b"
    assert "hunter2" not in edit["input"]["old_string"] and edit["duration_ms"] == 4000
    assert (read["result"], read["is_error"], read["duration_ms"]) == ("x\ny", True, None)
    assert tuple(bash["bash"]) == ("pytest -q", "2 passed") and bash["duration_ms"] == 6000
    assert rows[5]["injection"] == "skill:tidy" and rows[6]["images"] == ["data:image/png;base64,QQ=="]
    assert rows[-1]["is_truncated"] and not rows[2]["is_truncated"]


def test_turns_and_documents(events):
    scene = sessions.scenes(events)
    turns = [tuple(r)[1:4] for r in sessions.turn_stats(scene).where("session = 'one'").orderBy("turn").collect()]
    assert turns == [(1, 2, ["Edit", "Read"]), (2, 3, ["Bash", "Write", "mcp__git__log"])]
    got = {r["session"]: json.loads(r["document"]) for r in sessions.documents(scene, sessions.scan(events)).collect()}
    assert len(got["one"]["scenes"]) == 11 and got["two"]["meta"]["prompt_count"] == 3


def test_header_sample_and_notes(spark, tmp_path):
    start = {"type": "system", "sessionId": "abcdefghijk", "version": "2", "timestamp": T.format(0)}
    more = [{"type": "progress", "n": n} for n in range(400)]
    asked = user(40, [{"type": "text", "text": "Please also "}, {"type": "text", "text": "write more tests"}])
    late = [assistant(41, "m9", [tool("t9", "Bash", command="ls")], model="claude-x-1"), {"type": "custom-title", "customTitle": "Late"}]
    rows = [start, *(r for r in LOG if isinstance(r, dict) and "customTitle" not in r), asked, "", *more, *late]
    (tmp_path / "a.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    (tmp_path / "b.jsonl").write_text(json.dumps(start))
    (tmp_path / "n.md").write_text("---\nname: build\ndescription: how to\ntype: project\n---\nUse make.\n")
    for size in ("128m", "2k"):  # in one split, and in many
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        (r,) = logs.header_sample(spark, str(tmp_path)).collect()
        assert (r["session_id"], r["slug"], r["version"], r["git_branch"]) == ("abcdefghijk", "abcdefgh", "2", "main")
        assert (r["timestamp"], r["title"], r["n_lines"], r["tool_calls"], r["edits"]) == ("2025-05-02T07:59:00Z", "Late", len(rows) - 1, 6, 2)
        assert r["prompts"] == ["Please repair the parser in lib.py", "Base directory for this skill: /skills/tidy more"]
        assert (r["prompt_count"], r["model"], r["duration_ms"], r["has_pr"]) == (5, "claude-x-1", 9000, True)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(logs.memory_notes(spark, str(tmp_path)).first())[1:] == ("build", "how to", "project", "Use make.")
    assert [r["length"] > 0 for r in logs.files(spark, str(tmp_path)).collect()] == [True, True]


def test_no_logs(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("\n")
    none = logs.events(spark, str(tmp_path))
    assert sessions.scan(none).count() == 0 and sessions.scenes(none).where(F.lit(True)).count() == 0


def test_scene_measures(events):
    scene = sessions.scenes(events, home="/home/me").where("session = 'one'").cache()
    files = {r["file"]: (r["reads"], r["edits"], r["added"]) for r in scene_stats.files(scene).collect()}
    assert files == {"~/p/lib.py": (0, 1, 0), "~/p/a.py": (1, 0, 0), "~/p/b.py": (0, 1, 1)}
    assert tuple(scene_stats.activity(scene).first())[1:] == (1, 2, 1, 1)
    assert [tuple(r)[1:] for r in scene_stats.commands(scene).collect()] == [("test", 1)]
    t = scene_stats.totals(scene).first()
    assert (t["scenes"], t["tools"], t["errors"], t["images"]) == (11, 5, 0, 1)
    assert scene_stats.timeline(scene, 4).agg(F.sum("n")).first()[0] == 11 and scene_stats.timeline(scene, 4).count() == 4
    grid = {(r["file"], r["turn"]): r["edits"] for r in scene_stats.file_grid(scene).collect()}
    assert grid == {("~/p/lib.py", 1): 1, ("~/p/lib.py", 2): 0, ("~/p/b.py", 1): 0, ("~/p/b.py", 2): 1}
    assert scene_stats.first_turn(scene).first()["tools"] == 2
    assert scene_stats.digest(scene).first()["digest"].startswith("=== TURN 1 (scene 0) ===\n[USER PROMPT]:\nPlease repair the parser in lib.py\n\n[ASSISTANT RESPONSE]:\n  - Thinking: hm\n  - Text: On it.\n  - Edit: ~/p/lib.py\n    b\n")


def test_turns_agents_and_usage(events):
    assert scene_stats.truncated(events).where("session = 'one'").first()["truncated"] == 1
    a = scene_stats.sub_agents(events).first()
    assert (a["session"], a["agent"], a["tools"], a["tokens"]) == ("one", "7", 1, 220)
    kinds = scene_stats.sub_agents(events).select("session", "agent", F.lit("explorer").alias("agent_type"))
    assert [tuple(r) for r in scene_stats.sub_agents_by_type(scene_stats.sub_agents(events), kinds).collect()] == [("one", "explorer", 1, 1, 220)]
    call, said = scene_stats.sub_agent_scenes(events, "/home/me").orderBy("rn").collect()
    assert (call["type"], call["diff"]["file_path"], call["diff"]["new_content"]) == ("tool-call", "~/p/lib.py", "q")
    assert "hunter2" not in call["result"] and "~/p/lib.py" in call["result"] and call["input"]["file_path"] == "~/p/lib.py"
    assert "abcdefghijkl" not in said["content"] and "chars total)" in said["content"] and len(said["content"]) < 1100
    assert scene_stats.sub_agent_scenes(events, limit=1).count() == 1 and scene_stats.agent_links(events).count() == 0
    turns = {r["turn"]: (r["model"], r["output"], r["context"]) for r in scene_stats.turn_usage(events).collect()}
    assert turns[1] == ("x-sonnet-4", 30, 107)
    assert {(r["kind"], r["n"]) for r in scene_stats.api_errors(events).collect()} == {("529", 1), ("overloaded_error", 1)}


def test_blocks(spark):
    df = spark.createDataFrame([("a\nb", "a\nc\nd", "*** Update File: x.py\n@@\n keep\n-old\n+new", 'say {oops {"k": {"n": 1}} end'), (None, "", None, None)], "old string, new string, patch string, text string")
    r, empty = df.select(blocks.line_delta(F.col("old"), F.col("new")).alias("d"), blocks.line_diff("old", "new").alias("diff"), blocks.patch_sides(F.col("patch")).alias("p"), blocks.first_json("text").alias("j")).collect()
    assert r["d"] == 1 and [tuple(x) for x in r["diff"]] == [("same", "a"), ("removed", "b"), ("added", "c"), ("added", "d")]
    assert tuple(r["p"]) == ("x.py", "keep\nold", "keep\nnew") and r["j"] == '{"k": {"n": 1}}'
    assert empty["d"] == 0 and empty["diff"] == [] and empty["j"] is None


def test_sub_agents_stand_under_their_calls(spark, tmp_path):
    (tmp_path / "s" / "subagents").mkdir(parents=True)
    start = [user(1, "Look around"), assistant(2, "m1", [tool("t1", "Agent", prompt="x"), tool("t2", "Agent", prompt="y"), tool("t3", "Bash", command="ls")])]
    links = [{"type": "progress", "parentToolUseID": f"t{k}", "data": {"type": "agent_progress", "agentId": f"a{k}"}} for k in (1, 2)]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, [*start, *links, user(30, [result("t1", "one"), result("t2", "two"), result("t3", "f")])])))
    for k in (1, 2):
        own = [user(3, f"task {k} of /home/me/p"), assistant(4, f"x{k}", [{"type": "thinking", "thinking": " "}, {"type": "text", "text": f"found {k}"}, tool(f"u{k}", "Read", file_path="/home/me/a.py")]), user(5, [result(f"u{k}", "code")])]
        (tmp_path / "s" / "subagents" / f"agent-a{k}.jsonl").write_text("\n".join(map(json.dumps, own)))
    (tmp_path / "s" / "subagents" / "agent-a1.meta.json").write_text('{"agentType": "Explore", "description": "looks"}')
    events = logs.events(spark, str(tmp_path))
    scene = scene_stats.with_sub_agents(sessions.scenes(events, "/home/me"), events, "/home/me", logs.agent_kinds(spark, str(tmp_path)))
    rows = scene.orderBy("scene_index").collect()
    assert [r["tool_name"] for r in rows] == [None, "Agent", "Agent", "Bash"] and rows[0]["sub_agent"] is None and rows[3]["sub_agent"] is None
    one, two = rows[1]["sub_agent"], rows[2]["sub_agent"]
    assert (one["agent_id"], one["agent_type"], one["description"], one["prompt"], one["model"]) == ("a1", "Explore", "looks", "task 1 of ~/p", "x-sonnet-4")
    assert (two["agent_id"], two["agent_type"], two["description"], two["tools"], two["texts"]) == ("a2", "unknown", None, 1, 1)
    assert [(x["type"], x.get("content"), x.get("result")) for x in map(json.loads, two["scenes"])] == [("text-response", "found 2", None), ("tool-call", None, "code")]
    document = json.loads(sessions.documents(scene, sessions.scan(events)).first()["document"])
    assert document["scenes"][1]["sub_agent"]["agent_type"] == "Explore" and len(document["scenes"][2]["sub_agent"]["scenes"]) == 2 and "sub_agent" not in document["scenes"][3]
