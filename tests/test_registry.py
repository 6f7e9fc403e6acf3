"""Every query that has SQL gives the rows that the SQL gives."""

import duckdb
import pandas as pd
import pytest
from test_functions import is_wide, longest_common, plain_wrap

from tracewell.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def one(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return f"{float(x):.6g}"
        return str(pd.Timestamp(x)) if hasattr(x, "year") else str(x)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    df = registry.QUERIES[name](spark, DATA)
    found = db.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)


def test_queries_without_sql_equal_plain_versions(spark):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: (r["same"], r["removed"], r["added"]) for r in registry.QUERIES["line_changes"](spark, DATA).collect()}
    assert set(got) == {d for d in texts if d - 1 in texts}
    for d in sorted(got)[::20]:
        old, new = ((texts[k] or "").split("\n") if texts[k] else [] for k in (d - 1, d))
        same = longest_common(old, new)
        assert got[d] == (same, len(old) - same, len(new) - same)
    shown = {r["doc_id"]: (r["lines"], r["width"]) for r in registry.QUERIES["wrapped_texts"](spark, DATA).collect()}
    assert shown == {d: (None, None) if x is None else ("\n".join(plain_wrap(" ".join(x.split())[:1000], 60, 3)), sum(2 if is_wide(c) else 1 for c in x)) for d, x in texts.items()}
    assert {"line_changes", "wrapped_texts"} == set(registry.QUERIES) - set(registry.ORACLE_SQL)
