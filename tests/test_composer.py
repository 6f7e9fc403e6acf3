import json

from pyspark.sql import functions as F

from tracewell.functions import composer as c


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_plans_go(spark):
    cases = {
        "Done.\n\n**Planning next steps**\n\nI need to look": "Done.",
        "Done.\n\n**Exploring code**\n\nIt is so": "Done.\n\n**Exploring code**\n\nIt is so",
        "**Thinking**\n\nI'll go": "",
        "a\n\n**Foo bar**\n\nx\n\n**Checking it**\n\n  let's see": "a\n\n**Foo bar**\n\nx",
        "x\n\n**Foo**\n\n**Planning**\n\nI need": "x\n\n**Foo**\n\n**Planning**\n\nI need",  # headings don't share blank lines
        "x\n\n**Waiting**\n\n" + "y " * 300 + "I think": "x\n\n**Waiting**\n\n" + "y " * 300 + "I think",  # beyond 500 characters
        "a😀\n\n**Scratchpad**\n\nWe\nshould": "a😀",
        " plain ": "plain",
        "": "",
        None: None,
    }
    got = dict(one(spark, [(k,) for k in cases], "t string", "t", c.without_plan(F.col("t"))))
    assert got == cases
    rows = [("a\n\n**Step one**\n\nI need", True), ("**Planning**\n\nI need", False), ("**Planning**\n\nI need", True), ("a\n\n**Planning**\n\nI need", False)]
    assert [r[0] for r in one(spark, rows, "t string, tools boolean", c.assistant_text(F.col("t"), F.col("tools")))] == [rows[0][0], rows[1][0], "", "a"]
    rows = [('{"text": "a\\n\\n**Planning**\\n\\nI need"}',), ("b",), ('{"x": 1}',), (None,)]
    assert [r[0] for r in one(spark, rows, "t string", c.thinking(F.col("t")))] == ["a", "b", "", ""]


def test_branches_and_links(spark):
    timed = {"createdOnBranch": "main", "branches": [{"branchName": "b", "lastInteractionAt": 2}, {"name": {"ref": "a"}, "lastInteractionAt": 1}], "activeBranch": {"branch": "main"}}
    plain = {"branches": ["z", "", {"branch": "y"}], "committedToBranch": " y "}
    rows = [(json.dumps(timed),), (json.dumps(plain),), ("{}",), (None,)]
    found = [tuple(r[0]) for r in one(spark, rows, "j string", c.branches(F.col("j")))]
    assert found == [("main", ["main", "a", "b"]), ("y", ["z", "y"]), (None, None), (None, None)]
    rows = [("main", ["main", "a", "b"]), ("b", ["a", "b"]), ("x", None), ("x", ["a", "b"]), (None, ["a", "b"]), ("a", ["a", "b", "a", "c"])]
    chains = [r[0] for r in one(spark, rows, "b string, c array<string>", c.branch_chain(F.col("b"), F.col("c")))]
    assert chains == [["a", "b", "main"], ["a", "b"], ["x"], ["a", "b"], None, ["a", "b", "c", "a"]]
    links = [{"prUrl": "https://github.com/o/r/pull/7", "number": 0}, {"url": "u", "prNumber": 3, "repository": "q"}, {"url": "none"}]
    bubbles = spark.createDataFrame([("s", 1, json.dumps({"pullRequests": links})), ("s", 2, json.dumps({"pullRequests": links[:1]})), ("s", 3, "{}"), ("s", 4, None)], "session string, position int, bubble string")
    assert {tuple(r) for r in c.pull_requests(bubbles).collect()} == {("s", "https://github.com/o/r/pull/7", 7, "o/r", 1), ("s", "u", 3, "q", 1)}


def test_context_files(spark):
    values = {"file:///a%20b/c+d.py": "/a b/c+d.py", "FILE://localhost/C:/x": "C:/x", " p ": "p", "a\nb": None, "": None, "file:///%zz": None, None: None}
    assert dict(one(spark, [(k,) for k in values], "v string", "v", c.context_file(F.col("v")))) == values
    bubbles = [("s", 0, json.dumps({"relevantFiles": ["b.py", {"fsPath": "a.py"}, {"name": "word"}, {"name": "n.md"}], "recentlyViewedFiles": ["b.py"]})), ("t", 0, "{}")]
    folder = {"directoryPath": "src/", "files": ["x.py", {"name": "y.py"}, {"path": "only/path"}]}
    requests = [("s", 0, json.dumps({"terminalFiles": ["t.log"], "attachedFoldersListDirResults": [folder, json.dumps({"files": ["q"]}), 5]})), ("s", 1, json.dumps({"cursorRules": [{"r": 1}]})), ("t", 0, json.dumps({"cursorRules": []}))]
    got = c.context(spark.createDataFrame(bubbles, "session string, position int, bubble string"), spark.createDataFrame(requests, "session string, position int, request string"))
    assert [tuple(r) for r in got.collect()] == [("s", ["b.py", "a.py", "n.md", "t.log", "src/x.py", "src/y.py", "only/path", "q"], 2, True)]


def test_project_roots(spark):
    roots = {
        "/home/u/proj/x.py": "/home/u/proj", "/home/u/.cache/x": None, "/workspaces/w/a": "/workspaces/w", "/workspace/.x": None, "/Users/u/code/tool/y": "/Users/u/code/tool", "/Users/u/code": None,
        "/srv/a/.git/config": "/srv/a", "/home/u/.config/x": None, "/tmp/x": None, "rel": None, "/home/u/p)\"": "/home/u/p",
    }
    assert dict(one(spark, [(k,) for k in roots], "p string", "p", c.root_of(F.col("p")))) == roots
    low = {"/home": True, "/home/u": True, "/home/u/p": False, "/tmp": True}
    assert dict(one(spark, [(k,) for k in low], "p string", "p", c.is_low_signal(F.col("p")))) == low
    known = spark.createDataFrame([("/home/u/proj",), ("/home/u/proj/sub/",), ("/data/tool",), ("/a/same",), ("/b/same",), ("",)], "path string")
    texts = {
        "s1": ('{"a":"file:///home/u/proj/sub/x.py"}', "/home/u/proj/sub"), "s2": ('"/home/u/project2/x.py"', "/home/u/project2"), "s3": ('"/Users/x/code/tool/y"', "/data/tool"),
        "s4": ("none", None), "s5": ('"/home/u/.cache/x" home/u/proj', "/home/u/proj"), "s6": ("/workspace/same/x", "/workspace/same"), "s7": (None, None),
    }
    got = c.with_project(spark.createDataFrame([(k, v[0]) for k, v in texts.items()], "session string, raw string"), known)
    assert {r["session"]: r["project"] for r in got.collect()} == {k: v[1] for k, v in texts.items()}
    names = spark.createDataFrame([("-home-u-my-app",), ("-x-y",), ("plain",)], "name string")
    dirs = spark.createDataFrame([("/home/u/my-app",), ("~/my-app",)], "path string")
    assert {r["name"]: r["project"] for r in c.known_dirs(names, dirs, "/home/u").collect()} == {"-home-u-my-app": "/home/u/my-app", "-x-y": "/x/y", "plain": "plain"}


def test_small_helpers(spark):
    text = "see\n [image] \n<image_files>\n1. /a/b.PNG\n ~/c d.jpg\nno.png\n/a/b.PNG\n</image_files>"
    row = spark.createDataFrame([(text,)], "t string").select(
        c.image_paths(F.col("t"), "/home/u/").alias("paths"), c.without_image_lines(F.lit("a\n[Image]\nb [image]")).alias("lines"), c.source_label(F.lit("jsonl")).alias("known"), c.source_label(F.lit("x")).alias("other"),
        c.source_label(F.lit(None).cast("string")).alias("none"), c.added_once(F.array(F.lit("a"), F.lit("a")), F.lit("b")).alias("added"), c.added_once(F.array(F.lit("a")), F.lit("a")).alias("same"),
        c.workspaces_hash(F.array(*map(F.lit, ("b", "a", "", "b")))).alias("many"), c.workspaces_hash(F.array(*map(F.lit, ("a", "b")))).alias("two"), c.merged_model(F.lit(None).cast("string"), F.lit("m")).alias("model"),
    ).first()
    assert row["paths"] == ["/a/b.PNG", "/home/u/c d.jpg"] and row["lines"] == "a\nb [image]"
    assert (row["known"], row["other"], row["none"], row["model"]) == ("JSONL transcript", "x", "unknown", "m")
    assert row["added"] == ["a", "a", "b"] and row["same"] == ["a"] and row["many"] == row["two"] and len(row["two"]) == 16
    usage = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"
    assert tuple(spark.createDataFrame([((1, 2, 3, None), None)], f"a {usage}, b {usage}").select(c.tokens_added(F.col("a"), F.col("b"))).first()[0]) == (1, 2, 3, 0)


def json_readings(df, capsys):
    df.explain()
    plan = capsys.readouterr().out
    return plan.count("get_json_object(") + plan.count("from_json(")


def test_branches_read_each_json_once(spark, capsys):
    composers = spark.createDataFrame([('{"createdOnBranch": "a", "branches": ["b"], "activeBranch": {"name": {"ref": "c"}}}',)], "v string")
    df = composers.select(c.branches(F.col("v")).alias("b"))
    assert df.first()[0].asDict() == {"branch": "c", "chain": ["a", "b", "c"]}
    assert json_readings(df, capsys) < 40
