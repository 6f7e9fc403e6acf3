"""Key/value tables by ranges of rows, with keys pushed into the files."""

import contextlib
import io
import sqlite3

import pytest

from tracewell.sources import kv, stores


@pytest.fixture
def root(tmp_path):
    for name in ("a", "b"):
        db = sqlite3.connect(tmp_path / f"{name}.db")
        db.execute("CREATE TABLE kv (key TEXT PRIMARY KEY, value)")
        db.executemany("INSERT INTO kv VALUES (?, ?)", [*((f"bubbleId:{name}:{n}", f"v{n}") for n in range(500)), *((f"composerData:{name}{n}", None if n == 3 else n) for n in range(20)), ("é:1", b"\xff\x00")])
        db.commit()
        db.close()
    db = sqlite3.connect(tmp_path / "c.db")
    db.execute("CREATE TABLE kv (key TEXT PRIMARY KEY, value) WITHOUT ROWID")
    db.execute("INSERT INTO kv VALUES ('composerData:c', 'x')")
    db.commit()
    db.close()
    (tmp_path / "broken.db").write_bytes(b"nothing at all")
    sqlite3.connect(tmp_path / "empty.db").close()
    return str(tmp_path)


def plain(df):
    return sorted((r["path"].split("/")[-1], r["key"], r["value"]) for r in df.collect())


def test_ranges_of_rows_are_read_once(spark, root):
    whole = plain(kv.rows(spark, root, "kv"))
    assert len(whole) == 2 * 521 + 1 and whole == plain(stores.rows(spark, root, "kv"))
    few = kv.rows(spark, root, "kv", rows=100)
    assert plain(few) == whole and few.rdd.getNumPartitions() == 2 * 6 + 1
    assert kv.rows(spark, root, "none").count() == 0


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_keys_are_pushed_into_the_files(spark, root):
    everything = kv.rows(spark, root, "kv")
    some = everything.where("key like 'composerData:%'")
    assert plain(some) == plain(stores.rows(spark, root, "kv", prefix="composerData:")) and some.count() == 41
    assert "StringStartsWith(key,composerData:)" in explained(some)
    assert plain(everything.where("key = 'composerData:a7'")) == [("a.db", "composerData:a7", b"7")]
    assert everything.where("key like 'é:%' and value is not null").count() == 2
    assert everything.where("key like 'composerData:%' and value is null").count() == 2
    reader = kv.KvReader({"path": root, "table": "kv"})
    assert list(reader.pushFilters([kv.StringStartsWith(("key",), "composerData:"), kv.EqualTo(("path",), "x")])) == [kv.EqualTo(("path",), "x")]
    assert reader.bounds == [(">=", "composerData:"), ("<", "composerData;")]
    assert kv.after("a\U0010ffff") == "b" and kv.after("퟿") == "" and kv.after("") is None
    plan = kv.connect(f"{root}/a.db").execute("EXPLAIN QUERY PLAN SELECT value FROM kv WHERE key >= 'c' AND key < 'd' AND rowid BETWEEN 1 AND 9").fetchall()
    assert "USING INDEX" in plan[0][3] or "PRIMARY KEY" in plan[0][3]
