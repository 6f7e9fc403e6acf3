import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracewell.plans import catalogue
from tracewell.sources import replays, stores


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    a, b = tmp_path_factory.mktemp("first"), tmp_path_factory.mktemp("second")

    def put(root, slug, **files):
        (root / slug).mkdir()
        for name, value in files.items():
            (root / slug / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value))

    scenes = [{"type": "user-prompt", "content": "short"}, {"type": "user-prompt", "content": "please mend the parser"}, {"type": "thinking", "content": "a long thought of mine"}, {"type": "user-prompt", "content": "and then the lexer"}]
    replay = {"meta": {"sessionId": "S", "title": "T", "startTime": "2025-01-02", "stats": {"n": 1}, "generator": {"version": "1.0"}}, "scenes": scenes}
    text = json.dumps(replay)
    put(a, "one", replay=text, annotations=[{"id": 1}, {"id": 2}], gist={"gistId": "g", "filename": "f", "contentHash": hashlib.sha256(text.encode()).hexdigest()[:16]}, cloud={"id": "c", "url": "u"}, overlays={"overlays": [{"o": 1}]})
    put(a, "two", replay={"meta": {"sessionId": "S2", "startTime": "2025-01-03"}}, annotations="broken", gist={"gistId": "g", "filename": "f", "contentHash": "old"}, cloud={"id": "c"}, overlays={"overlays": 3})
    put(a, "bad", replay="{no json")
    put(b, "one", replay={"meta": {"sessionId": "other"}}, annotations=[{"id": 9}])
    put(b, "three", replay={"meta": {"sessionId": "S3"}, "scenes": []}, annotations=[], overlays={"overlays": [{"o": 2}, {"o": 3}]})
    return [str(a), str(b)]


def test_scan_of_replays(spark, roots):
    rows = replays.scan(spark, roots, "gist.json", "cloud.json", version="2.0").collect()
    assert [r["slug"] for r in rows] == ["two", "one", "three"]
    two, one, three = rows
    assert (one["session"], one["title"], one["stats"], one["annotation_count"], one["replay_outdated"]) == ("S", "T", '{"n":1}', 2, True)
    assert one["messages"] == ["please mend the parser", "and then the lexer"] and three["messages"] is None
    assert one["gist"]["outdated"] is False and two["gist"]["outdated"] is True and three["gist"] is None
    assert one["cloud"]["url"] == "u" and two["cloud"] is None and (two["annotation_count"], two["replay_outdated"]) == (0, False)
    source = spark.createDataFrame([("S", "/p"), ("X", "/q")], "session string, path string")
    assert [(r["slug"], r["path"]) for r in replays.to_regenerate(replays.scan(spark, roots, "gist.json", "cloud.json"), source).collect()] == [("one", "/p")]


def test_documents_and_sidecars(spark, roots):
    got = replays.load(spark, roots, "one").collect()
    assert len(got) == 1 and json.loads(got[0]["replay"])["meta"]["sessionId"] == "S" and len(json.loads(got[0]["annotations"])) == 2
    assert replays.load(spark, roots, "three").first()["annotations"] is None and replays.load(spark, roots, "none").count() == 0
    assert {(r["slug"], r["position"], json.loads(r["annotation"])["id"]) for r in replays.annotations(spark, roots).collect()} == {("one", 0, 1), ("one", 1, 2)}
    assert {(r["slug"], r["position"], json.loads(r["overlay"])["o"]) for r in replays.overlays(spark, roots).collect()} == {("one", 0, 1), ("three", 0, 2), ("three", 1, 3)}


def test_markers_images_and_stores(spark, tmp_path):
    (tmp_path / "archive").mkdir()
    (tmp_path / "archive" / "one").write_text("")
    (tmp_path / "archive" / "two").write_text("x")
    assert {r[0] for r in replays.archived(spark, [str(tmp_path / "archive"), str(tmp_path / "none")]).collect()} == {"one", "two"}
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.JPG").write_bytes(b"\xff\x00")
    (tmp_path / "img" / "b.txt").write_bytes(b"x")
    assert [tuple(r) for r in replays.images(spark, str(tmp_path / "img")).collect()] == [(str(tmp_path / "img" / "a.JPG"), "data:image/jpeg;base64," + base64.b64encode(b"\xff\x00").decode())]
    ws, sid = hashlib.md5(b"/home/u/p").hexdigest(), "0a0a0a0a-1111-2222-3333-444444444444"
    for at, size in ((sid, 9000), ("1" + sid[1:], 10), ("no-id", 9000)):
        (tmp_path / "chats" / ws / at).mkdir(parents=True)
        (tmp_path / "chats" / ws / at / "store.db").write_bytes(b"0" * size)
    index = stores.index(spark, str(tmp_path / "chats"))
    known = spark.createDataFrame([("/home/u/p",), ("/home/u/p",), ("/x",)], "path string")
    assert [(r["session"], r["length"], r["project"]) for r in stores.with_workspace(index, known).collect()] == [(sid, 9000, "/home/u/p")]
    kv = spark.createDataFrame([(f"composerData:{sid}",), ("composerData:x",), (f"checkpointId:{sid}:1",), (f"checkpointId:{sid}:2",), ("messageRequestContext:s:1",)], "key string").withColumn("value", F.encode(F.lit("{}"), "UTF-8"))
    wanted = spark.createDataFrame([(sid,), ("y",)], "session string")
    assert [r[0] for r in stores.present(wanted, kv).collect()] == [sid]
    assert [tuple(r) for r in stores.checkpoints(kv).collect()] == [(sid, 2)]
    assert [tuple(r) for r in stores.request_contexts(kv).collect()] == [("s", 1, "{}")]


def test_choices(spark):
    rows = spark.createDataFrame([("a", "p", 1), ("b", "q", 3), ("c", "p", 5), ("d", "q", 4)], "session string, project string, modified int")
    assert [r["session"] for r in catalogue.choices(rows).collect()] == ["c", "a", "d", "b"]
