"""Sessions of the second provider from transcripts and stores to scenes and rows; results at any depth."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracewell.functions import results
from tracewell.plans import sessions
from tracewell.sources import stores, transcripts

PNG = {"type": "image", "source": {"media_type": "image/png", "data": "QQ=="}}


def text(t):
    return {"type": "text", "text": t}


def call(id, name, **args):
    return {"type": "tool_use", "id": id, "name": name, "input": args}


def line(role, *blocks, ts=None):
    return {"role": role, "message": {"content": list(blocks)}} | ({"timestamp": ts} if ts else {})


LINES = [
    line("user", text("<user_query>Please mend /home/me/p/a.py</user_query>"), PNG, ts="2025-05-02T08:00:00Z"),
    line("assistant", text("On it."), call("t1", "StrReplace", path="/home/me/p/a.py", old_string="password=hunter2hunter2", new_string="b"), call("t2", "Shell", command="pytest -q"), ts="2025-05-02T08:00:30Z"),
    line("user", {"type": "tool_result", "tool_use_id": "t2", "content": "1 failed", "is_error": True}, ts="2025-05-02T08:01:00Z"),
    line("assistant", call("t3", "Task", subagent_type="explore", description=" look ", prompt="in /home/me/p"), call("t4", "Write", path="/home/me/p/b.py", contents="z"), call("t5", "mcp__git__log", n=1), ts="2025-05-02T08:02:00Z"),
]


@pytest.fixture
def turns(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, LINES)))
    return transcripts.turns(transcripts.entries(spark, str(tmp_path)))


def test_scenes_of_a_transcript(turns):
    rows = transcripts.scenes(turns, "/home/me").orderBy("scene_index").collect()
    assert [(r["scene_index"], r["type"], r["tool_name"]) for r in rows] == [(0, "user-prompt", None), (1, "text-response", None), (2, "tool-call", "Edit"), (3, "tool-call", "Bash"), (4, "tool-call", "Agent"), (5, "tool-call", "Write"), (6, "tool-call", "mcp__git__log")]
    assert rows[0]["content"] == "Please mend ~/p/a.py"
    assert rows[2]["diff"]["file_path"] == "~/p/a.py" and "hunter2" not in rows[2]["diff"]["old_content"] and rows[2]["diff"]["new_content"] == "b"
    assert tuple(rows[3]["bash"]) == ("pytest -q", "1 failed") and rows[3]["is_error"]
    assert tuple(rows[4]["sub_agent"]) == ("t3", "Explore", "look", "in ~/p") and rows[5]["diff"]["new_content"] == "z"
    made = transcripts.scenes(turns, "/home/me")
    assert set(made.columns) == {*sessions_columns(), "sub_agent"}


def sessions_columns():
    return {"session", "scene_index", "ts", "type", "content", "tool_name", "input", "result", "is_error", "duration_ms", "diff", "bash", "is_truncated", "injection", "images", "tool_id"}


def test_row_of_a_transcript(spark, turns):
    (r,) = transcripts.session_rows(turns, "/home/me").collect()
    assert (r["session"], r["first_prompt"], r["prompt_count"], r["tool_call_count"], r["edit_count"], r["sub_agent_count"]) == ("s1", "Please mend /home/me/p/a.py", 1, 5, 2, 1)
    assert (r["start_time"], r["end_time"], r["duration_ms"], r["cost"]) == ("2025-05-02T08:00:00Z", "2025-05-02T08:02:00Z", 120_000, None)
    assert [tuple(x) for x in r["files_modified"]] == [("~/p/a.py", 1), ("~/p/b.py", 1)] and r["mcp_servers_used"] == ["git"]
    wide = set(sessions.scan.__doc__ and r.asDict())
    assert {"title", "git_branch", "git_branches", "pr_links", "model", "api_error_count", "compaction_count", "entrypoint", "permission_mode", "skills_used", *sessions.TOKENS} <= wide
    info = spark.createDataFrame([("s1", "Parser", 5000, 3)], "session string, title string, duration_ms bigint, sub_agent_count bigint")
    usage = spark.createDataFrame([("s1", "x-sonnet-4", 1_000_000, 0, 0, 0)], "session string, model string, " + ", ".join(f"{c} bigint" for c in sessions.TOKENS))
    (r,) = transcripts.session_rows(turns, info=info, usage=usage).collect()
    assert (r["title"], r["first_prompt"], r["duration_ms"], r["sub_agent_count"], r["cost"]) == ("Parser", "Parser", 5000, 3, 3.0)


def test_a_store_end_to_end(spark, tmp_path, turns):
    db = sqlite3.connect(tmp_path / "state.db")
    db.execute("CREATE TABLE kv (key TEXT, value BLOB)")
    deep = json.dumps([[[[json.dumps({"output": {"success": False}})]]]])
    ran = json.dumps({"output": "2 passed", "exitCode": 0, "executionTimeMs": 1500})
    composer = {"name": " A  title ", "createdAt": 1746172800000, "lastUpdatedAt": 1746172900000, "fullConversationHeadersOnly": [{"bubbleId": f"b{k}"} for k in range(1, 5)], "modelConfig": {"modelName": "x-sonnet-4"}, "createdOnBranch": "main", "committedToBranch": {"name": "fix"}}
    bubbles = {
        "b1": {"type": 1, "text": "please", "createdAt": 1746172800000},
        "b2": {"type": 2, "text": "done", "thinking": "hm", "createdAt": 1746172810000, "toolFormerData": {"name": "run_terminal_cmd", "params": '{"command":"pytest -q"}', "result": ran, "toolCallId": "c1"}, "tokenCount": {"inputTokens": 1_000_000}, "pullRequests": ['{"url": "https://github.com/e/p/pull/4", "number": 4}']},
        "b3": {"type": 2, "createdAt": 1746172820000, "toolFormerData": {"name": "search_replace", "params": '{"file_path":"/home/me/p/a.py","old_string":"a","new_string":"b"}', "result": deep, "toolCallId": "c2"}},
        "b4": {"type": 1, "text": "thanks", "createdAt": 1746172830000},
    }
    db.executemany("INSERT INTO kv VALUES (?, ?)", [("composerData:s1", json.dumps(composer)), *((f"bubbleId:s1:{k}", json.dumps(v)) for k, v in bubbles.items())])
    db.commit()
    db.close()
    kv = stores.rows(spark, str(tmp_path), "kv")
    c = stores.composers(kv)
    (r,) = c.collect()
    assert (r["branch"], r["branches"]) == ("fix", ["main", "fix"])
    b = stores.bubbles(kv, c)
    made = stores.turns(b)
    with_images = transcripts.with_images(made, transcripts.user_images(transcripts.entries(spark, str(tmp_path))))
    scenes = transcripts.scenes(with_images, "/home/me").orderBy("scene_index").collect()
    assert [(s["type"], s["content"], s["tool_name"]) for s in scenes] == [("user-prompt", "please", None), ("thinking", "hm", None), ("text-response", "done", None), ("tool-call", None, "Bash"), ("tool-call", None, "Edit"), ("user-prompt", "thanks", None)]
    assert scenes[0]["images"] == ["data:image/png;base64,QQ=="] and scenes[5]["images"] == []
    assert (scenes[3]["result"], scenes[3]["duration_ms"], scenes[3]["is_error"]) == ("2 passed\n[exitCode: 0]", 1500, False) and scenes[4]["is_error"]
    (r,) = transcripts.session_rows(made, "/home/me", stores.info(c, stores.pull_requests(kv, c)), stores.usage(b)).collect()
    assert (r["title"], r["git_branch"], r["git_branches"], r["model"], r["prompt_count"], r["edit_count"], r["duration_ms"], r["cost"]) == ("A title", "fix", ["main", "fix"], "x-sonnet-4", 2, 1, 30_000, 3.0)
    assert [x["pr_url"] for x in r["pr_links"]] == ["https://github.com/e/p/pull/4"] and r["data_source"] == "global-state"


def test_results_at_any_depth(spark):
    wrap = lambda x, n: x if not n else wrap(json.dumps([x] if n % 2 else x), n - 1)
    cases = [
        ("plain", "plain", False, None), ("", "", False, None), (None, "", False, None), ("12", "", False, None), ('"  "', "  ", False, None), ('["a", "", ["b", {"contents": "c"}]]', "a\nb\nc", False, None),
        (json.dumps({"output": "x", "exitCode": 1}), "x\n[exitCode: 1]", False, None), (json.dumps({"result": json.dumps({"markdown": "m"})}), "m", False, None), (json.dumps({"result": "[]"}), "[]", False, None),
        (json.dumps({"content": [{"text": "a"}, {"no": 1}, {"text": "b"}]}), "a\nb", False, None), ('{"n": 1.0, "é": [1]}', '{\n  "n": 1,\n  "é": [\n    1\n  ]\n}', False, None),
        (wrap(json.dumps({"error": "bad"}), 5), None, True, None), (wrap(json.dumps({"output": {"failure": {"executionTime": "7.6"}}}), 4), None, True, 8),
        (json.dumps({"rejected": {}}), None, True, None), (json.dumps({"error": {"code": 1}, "failure": 0, "output": {"success": True}}), None, False, None), (json.dumps([{"localExecutionTimeMs": -1}, {"executionTimeMs": 3}]), None, False, 3),
        ("[" * 5000 + "]" * 5000, "[" * 5000 + "]" * 5000, False, None), ("[NaN]", "[NaN]", False, None),
    ]
    df = spark.createDataFrame([(n, c[0]) for n, c in enumerate(cases)], "n int, r string")
    for (_, want, failed, ms), r in zip(cases, df.select("n", results.told(F.col("r")).alias("t")).orderBy("n").collect(), strict=True):
        assert (r["t"]["failed"], r["t"]["ms"]) == (failed, ms) and want in (None, r["t"]["text"]), r


def test_outputs_belong_to_the_next_transcript(spark, tmp_path):
    files = {"p/agent-transcripts/a.jsonl": 100, "p/agent-transcripts/b/b.jsonl": 200, "p/agent-transcripts/b/other.jsonl": 120, "p/agent-tools/1.txt": 90, "p/agent-tools/2.txt": 100, "p/agent-tools/3.txt": 101, "p/agent-tools/4.txt": 201, "q/agent-transcripts/c.jsonl": 1000, "q/agent-tools/5.txt": 1, "r/agent-tools/6.txt": 1}
    for name, at in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}" if name.endswith("jsonl") else " \n" if name.endswith("2.txt") else f" result of {name} ")
        os.utime(tmp_path / name, (1_700_000_000 + at,) * 2)
    got = transcripts.listed_outputs(spark, str(tmp_path))
    assert sorted((r["project"][-1], r["session"], r["id"]) for r in got.collect()) == [("p", "a", "1"), ("p", "a", "2"), ("p", "b", "3"), ("q", "c", "5")]
    assert sorted((r["session"], r["id"], r["result"]) for r in transcripts.outputs(spark, str(tmp_path)).collect()) == [("a", "1", "result of p/agent-tools/1.txt"), ("b", "3", "result of p/agent-tools/3.txt"), ("c", "5", "result of q/agent-tools/5.txt")]
