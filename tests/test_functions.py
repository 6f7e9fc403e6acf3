"""Diffs, pieces of JSON, lines of bounded width, digests and formats against plain versions."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tracewell.functions import blocks, diff, layout, partial_json, text
from tracewell.plans import scene_stats


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_a_diff_keeps_as_many_lines_as_can_be():
    rng = random.Random(1)
    for n in range(2500):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 14 if n % 50 else 120))] for _ in range(2))
        got = diff.edits(a, b)
        assert [x for k, x in got if k != "added"] == a and [x for k, x in got if k != "removed"] == b
        assert sum(k == "same" for k, _ in got) == longest_common(a, b)


def test_long_files_are_compared_in_bounded_time():
    rng = random.Random(2)
    old = [f"line {n}" for n in range(20_000)]
    new = [x for x in old if rng.random() > 0.02]
    for _ in range(300):
        new[rng.randrange(len(new))] = f"new {rng.random()}"
    began = time.time()
    assert len(diff.matches(old, new)) == len(set(old) & set(new))
    assert diff.matches(old, [x + "!" for x in old]) == [] and len(diff.matches(["x"] * 20_000, ["x"] * 10_000)) == 10_000
    assert time.time() - began < 30


def plain_repair(whole, cut):
    """What is whole of a cut object: the longest start of it that closing brackets make JSON, ending with a whole member."""
    s = whole[:cut]
    for end in range(len(s), 0, -1):
        if s[end - 1] not in '}]"{[elE0123456789':
            continue
        if end == len(s) and s[-1].isdigit():
            continue
        stack, string, escape = [], False, False
        for ch in s[:end]:
            if escape:
                escape = False
            elif ch == "\\" and string:
                escape = True
            elif ch == '"':
                string = not string
            elif not string and ch in "{[":
                stack.append("}" if ch == "{" else "]")
            elif not string and ch in "}]":
                stack.pop()
        if string:
            continue
        try:
            json.loads(s[:end] + "".join(reversed(stack)))
        except ValueError:
            continue
        if end < len(s) and s[end - 1].isdigit() and s[end] not in ",]} ":
            continue
        return s[:end] + "".join(reversed(stack))


def test_cut_objects_are_closed_after_their_last_whole_member():
    rng = random.Random(3)

    def value(depth):
        kind = rng.randint(0, 6 if depth else 4)
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        if kind == 6:
            return {rng.choice(["a", "b}", 'c"', "d\\", "é{"]): value(depth - 1) for _ in range(rng.randint(0, 3))}
        return rng.choice(["x", "", '"{', "\\", "]}", 0, -12, 3.5, 1e30, True, False, None])

    for _ in range(300):
        whole = json.dumps({"k": value(3), "l": value(3)}, ensure_ascii=rng.random() < 0.5)
        assert partial_json.read(f"say {whole} and }} more") == whole
        for cut in range(1, len(whole)):
            got = partial_json.read(whole[:cut], repair=True)
            json.loads(got)
            assert got == plain_repair(whole, cut), (whole, cut)


@pytest.mark.parametrize(
    "given, first, repaired",
    [
        ('say {oops {"k": {"n": 1}} end', '{"k": {"n": 1}}', '{"k": {"n": 1}}'),
        ('{bad} {"g": null}', '{"g": null}', '{"g": null}'),
        ('{"a": 1,} {"a": 01} {"b": tru}', None, None),
        ('```json\n{"a": [1]}\n```', '{"a": [1]}', '{"a": [1]}'),
        ('{"a": {"b": 1}, "c', '{"b": 1}', '{"a": {"b": 1}}'),
        ('it said "hi" { "a" : "x\\n" , "b', None, '{ "a" : "x\\n"}'),
        ("[1, 2", None, None),
        ("}}}]]", None, None),
        ('{"a": "\x01"}', None, None),
        ("", None, None),
    ],
)
def test_json_inside_text(given, first, repaired):
    assert partial_json.read(given) == first and partial_json.read(given, repair=True) == repaired


def test_json_is_read_in_linear_time():
    began = time.time()
    for s in ("{" * 1_000_000, '{"a":' * 200_000, '{"a":[1,' * 100_000, '{"' * 300_000, '{"a' + '\\"' * 500_000, "{x}" * 300_000, "{[" * 400_000 + "}" * 400_000):
        partial_json.read(s, repair=True)
    assert time.time() - began < 40


def is_wide(ch):
    code = ord(ch)
    return 0x3000 <= code <= 0x9FFF or 0xAC00 <= code <= 0xD7AF or 0xF900 <= code <= 0xFAFF or 0xFF00 <= code <= 0xFF60 or 0x20000 <= code <= 0x2FA1F


def plain_wrap(s, width, lines):
    """Character by character."""
    wide = lambda x: sum(2 if is_wide(c) else 1 for c in x)
    rest = " ".join(s.split())

    def condense(x):
        if wide(x) <= width:
            return x
        while wide(x) > width - 1:
            x = x[:-1]
        return x + "…"

    out = []
    while rest or not out:
        if len(out) == lines - 1 or wide(rest) <= width:
            return [*out, condense(rest)]
        n, units, blank, at_blank = 0, 0, -1, -1
        while n < len(rest) and wide(rest[: n + 1]) <= width:
            if rest[n] == " ":
                blank, at_blank = n, units
            units += 2 if ord(rest[n]) > 0xFFFF else 1
            n += 1
        at = blank if at_blank > units * 0.3 else n
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return out


def test_wrapping_equals_a_plain_version(spark):
    rng = random.Random(4)
    words = ["a", "word", "longer-word-here", "漢字", "かな漢字交じり文", "한국어", "𠀀𠀁", "é", "🎉", "ｆｕｌｌ", "x" * 30, "\n", "\t "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) + rng.choice(["", " ", "漢" * 20]) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for width, lines in ((20, 3), (11, 2), (40, 1), (7, 5)):
        got = df.select(layout.wrap(F.col("t"), width, lines).alias("w"), layout.condense(F.col("t"), width).alias("c")).collect()
        assert [r["w"] for r in got[:-1]] == [plain_wrap(t, width, lines) for t in texts] and got[-1]["w"] is None
        assert [r["c"] for r in got[:-1]] == [plain_wrap(t, width, 1)[0] for t in texts]
    widths = [r[0] for r in df.where("t is not null").select(text.visual_width(F.col("t"))).collect()]
    assert widths == [sum(2 if is_wide(c) else 1 for c in t) for t in texts]


def plain_digest(scenes, limit):
    prompts = max(sum(s["type"] == "user-prompt" for s in scenes), 1)
    most = {k: min(a, b // prompts) for k, (a, b) in {"prompt": (3000, 25000), "response": (1500, 20000), "diff": (500, 8000), "output": (300, 5000)}.items()}
    short = lambda s, n: s if len(s) <= n else s[:n] + "..."
    lines, own, used, turn = [], [], 0, 0
    for s in scenes:
        kind, said = s["type"], s["content"] or ""
        if kind == "user-prompt":
            lines += [*own, ""] if own else []
            own, used, turn = [], 0, turn + 1
            own += [f"=== TURN {turn} (scene {s['scene_index']}) ===", "[USER PROMPT]:", said if len(said) <= most["prompt"] else said[: most["prompt"]] + "\n...(truncated)", "", "[ASSISTANT RESPONSE]:"]
        elif kind == "compaction-summary":
            own.append("  - [Context compaction — earlier context was summarized]")
        elif kind in ("thinking", "text-response") and used < most["response"]:
            part = short(said, 200 if kind == "thinking" else most["response"] - used)
            own.append(f"  - {'Thinking' if kind == 'thinking' else 'Text'}: {part}")
            used += len(part)
        elif kind == "tool-call" and s["diff"]:
            own.append(f"  - {s['tool_name']}: {s['diff'][0]}")
            changed = s["diff"][2] or s["diff"][1]
            if changed and used < most["response"]:
                part = short(changed, most["diff"])
                own.append("    " + part.replace("\n", "\n    "))
                used += len(part)
        elif kind == "tool-call" and s["bash"]:
            own.append(f"  - Bash: {short(s['bash'][0], 120)}")
            out = s["bash"][1].strip()
            if out and used < most["response"]:
                part = short(out, most["output"])
                own.append("    Output: " + part.replace("\n", "\n    "))
                used += len(part)
        elif kind == "tool-call":
            own.append(f"  - {s['tool_name']}: {json.dumps(s['input'], separators=(',', ':'))[:100]}")
    lines += [*own, ""] if own else []
    whole = "\n".join(lines)
    return whole if len(whole) <= limit else whole[:limit] + "\n\n... (remaining turns omitted due to length)"


@pytest.mark.parametrize("prompts, limit", [(0, 50_000), (1, 50_000), (10, 50_000), (100, 50_000), (100, 3000)])
def test_digest_equals_a_plain_version(spark, prompts, limit):
    rng = random.Random(prompts)
    kinds = ["thinking", "text-response", "edit", "bash", "other", "context-injection", "compaction-summary"]
    scenes = []
    for n in range(prompts * 6 + 5):
        kind = "user-prompt" if n % 6 == 5 and prompts else rng.choice(kinds)
        said = "".join(rng.choice("ab \n") for _ in range(rng.choice([0, 1, 50, 199, 201, 900, 4000])))
        row = {"session": 1, "scene_index": n, "type": kind, "content": said, "tool_name": None, "input": None, "diff": None, "bash": None}
        if kind in ("edit", "bash", "other"):
            row |= {"type": "tool-call", "content": None, "tool_name": "Edit", "input": {"a": said[:90], "n": "1"}}
            row |= {"diff": ("f.py", "old", said)} if kind == "edit" else {"tool_name": "Bash", "bash": (said[:130], said)} if kind == "bash" else {"tool_name": "Task"}
        scenes.append(row)
    schema = "session bigint, scene_index bigint, type string, content string, tool_name string, input map<string,string>, diff struct<file_path:string,old_content:string,new_content:string>, bash struct<command:string,stdout:string>"
    df = spark.createDataFrame(scenes, schema).repartition(3)
    assert scene_stats.digest(df, limit).first()["digest"] == plain_digest(scenes, limit)


def test_timeline_has_the_pieces_of_its_edges(spark):
    for n in (7, 200, 201, 300, 1999):
        df = spark.range(n).selectExpr("1 as session", "id as scene_index", "case when id % 7 = 0 then 'context-injection' when id % 5 = 0 then 'thinking' when id % 3 = 0 then 'text-response' else 'tool-call' end as type")
        got = {r["bucket"]: (r["type"], r["n"]) for r in scene_stats.timeline(df).collect()}
        kind = lambda i: "context-injection" if i % 7 == 0 else "thinking" if i % 5 == 0 else "text-response" if i % 3 == 0 else "tool-call"
        edges = [int(b * n / 200) for b in range(201)] if n > 200 else range(n + 1)
        rank = {"tool-call": 3, "text-response": 2}
        want = {b: (max((kind(i) for i in range(x, y)), key=lambda t: rank.get(t, 1)), y - x) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True))}
        assert got == want, n


def test_failed_commands(spark):
    rows = [("Bash", None, "x Error: y", True), ("Bash", None, "failed", False), ("Bash", None, " " * 500 + "error", False), ("Bash", False, "error", False), ("Bash", True, "", True), ("Read", True, "error", False), ("Bash", None, None, False)]
    df = spark.createDataFrame([("tool-call", *r) for r in rows], "type string, tool_name string, is_error boolean, result string, want boolean")
    assert all(r[0] == r[1] for r in df.select(scene_stats.failed(), "want").collect())


def test_formats(spark):
    now = "2025-03-11T12:00:00Z"
    df = spark.createDataFrame([("2025-03-11T11:59:30Z",), ("2025-03-11T11:01:00Z",), ("2025-03-10T13:00:00Z",), ("2025-02-20T12:00:00Z",), ("2025-01-02T03:04:00Z",), ("2025-03-11T13:00:00Z",), ("x",), (None,)], "at string")
    got = df.select(text.time_ago(F.col("at"), now), text.compact_age(F.col("at"), now)).collect()
    assert [tuple(r) for r in got] == [("just now", "0m"), ("59m ago", "59m"), ("23h ago", "23h"), ("19d ago", "19d"), ("Jan 2, 2025, 03:04", "68d"), ("just now", "0m"), (None, "0m"), (None, "")]
    names = {"claude-3-5-sonnet-20241022": "Sonnet 3.5", "claude-sonnet-4-20250514": "Sonnet 4", "claude-opus-4-6": "Opus 4.6", "claude-opus-4-6-20250619": "Opus 4.6", "claude-4-sonnet": "Sonnet 4", "claude-4.5": "Claude 4.5", "gpt-4o-mini": "gpt-4o", "auto": "auto", "": "", None: ""}
    df = spark.createDataFrame([(k,) for k in names], "m string")
    assert [r[0] for r in df.select(text.short_model(F.col("m"))).collect()] == list(names.values())
    times = {0: "0m", 59 * 60_000: "59m", 3_600_000: "1h", 4_000_000: "1h 6m", 86_400_000: "1d", 97_200_000: "1d 3h"}
    df = spark.createDataFrame([(k,) for k in times], "ms bigint")
    assert [r[0] for r in df.select(text.compact_duration(F.col("ms"))).collect()] == list(times.values())
    labels = {"~/a": "~/a", "~": "Home", "~/": "Home", "(globalStorage)": "Cursor Global Storage", "~/code/some/deep/project/xy": "~/…/project/xy", "~/c/" + "d" * 20 + "/e" * 3: "~/…/e/e", "~/c/" + "d" * 30: "~/…/" + "d" * 30, "/u/.cursor/extensions/z": "Cursor Extension", "/u/.cursor/projects/p/terminals": "Cursor Terminals"}
    df = spark.createDataFrame([(k,) for k in labels], "p string")
    assert [r[0] for r in df.select(text.project_label(F.col("p"))).collect()] == list(labels.values())
    (r,) = spark.createDataFrame([("a <b> & 'c' 😀  d", "[x](y)*_`\\", "A title: with/odd  chars — " + "z" * 80)], "a string, b string, c string").select(text.escape_xml(F.col("a")), text.escape_markdown(F.col("b")), text.safe_filename(F.col("c"))).collect()
    assert tuple(r) == ("a &lt;b&gt; &amp; &apos;c&apos; d", r"\[x\]\(y\)\*\_\`\\", ("A-title-with-odd-chars-" + "z" * 80)[:60])


def test_diff_and_json_columns(spark):
    df = spark.createDataFrame([("a\nb", "a\nc\nd", '{"k": [1, 2', 1), (None, "", None, 2)], "old string, new string, t string, n int").orderBy("n")
    r, empty = df.select(blocks.line_diff("old", "new").alias("d"), blocks.first_json("t").alias("j"), blocks.repaired_json("t").alias("r")).collect()
    assert [tuple(x) for x in r["d"]] == [("same", "a"), ("removed", "b"), ("added", "c"), ("added", "d")] and r["j"] is None and r["r"] == '{"k": [1]}'
    assert empty["d"] == [] and empty["j"] is None and empty["r"] is None


def test_prompts_are_searched_once_for_each_pattern(spark, capsys):
    df = spark.createDataFrame([("Ann [9:05 am]\nHello\n➜ git status\n do \t <b>this</b>  \n\n  now",)], "v string").select(text.clean_prompt(F.col("v")).alias("p"))
    assert df.first()[0] == "do this now"
    df.explain()
    plan = capsys.readouterr().out
    assert plan.count("regexp_replace(") + plan.count("RLIKE") < 40
