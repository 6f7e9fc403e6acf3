"""Secret scan against its expressions and a plain entropy."""

import collections
import hashlib
import math
import random
import re
import time

from tracewell.llm import queries, secret_scan

#: Fixed values of the query's contract.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in collections.Counter(s).values())


def plain_windows(run, size, bits, kinds):
    spans = []
    for i in range(len(run) - size + 1):
        w = run[i : i + size]
        if entropy(w) >= bits and all(re.search(f"[{k}]", w) for k in kinds):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + size
            else:
                spans.append([i, i + size])
    return spans


def test_base_spans_equal_the_plain_expressions():
    rng = random.Random(3)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "APIKEY", "api", '"', "'", " ", "  ", ":", "=", "abcd1234", "x.y-z", "AKIA", "AKIAIOSFODNN7", "0f" * 9, "é", "ſecret", "toKen", "=="]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secret_scan.base_spans(text) == plain(text), text


def test_window_entropy_equals_the_plain_formula():
    rng = random.Random(4)
    for name, pattern, size, bits, kinds in secret_scan.CLASSES:
        letters = [chr(c) for c in range(33, 127) if re.match(pattern, chr(c))]
        runs = ["".join(rng.choice(letters[: rng.choice((3, 12, len(letters)))]) for _ in range(rng.randint(size, 400))) for _ in range(40)]
        got = secret_scan.high_windows([r.encode() for r in runs], size, bits, kinds)
        for run, spans in zip(runs, got, strict=True):
            assert [[s, e] for s, e, _ in spans] == plain_windows(run, size, bits, kinds), (name, run)
            for s, e, level in spans:
                assert abs(level - max(entropy(run[i : i + size]) for i in range(s, e - size + 1) if all(re.search(f"[{k}]", run[i : i + size]) for k in kinds))) < 1e-4


def kinds_in(text):
    return [secret_scan.KINDS[k] for _, k, _, _ in secret_scan.find([text])[0]]


def test_entropy_finds_random_strings_and_leaves_words_and_allowed_ones_alone():
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = "".join(rng.choice(letters) for _ in range(60))
    assert kinds_in(f"send {key} now") == ["entropy_base64"]
    assert secret_scan.find([f"é {key}."])[0][0][:3] == (2, secret_scan.KINDS.index("entropy_base64"), 62)
    assert kinds_in("key " + "".join(rng.choice("0123456789ABCDEF") for _ in range(40))) == ["entropy_hex"]
    assert kinds_in(f"https://example.org/{key}") == kinds_in(f"data:image/png;base64,{key}") == kinds_in(f"sha512-{key}") == kinds_in(f"{key}EXAMPLE") == []
    assert kinds_in(f"https://a.org/?q={key}") == ["entropy_base64"]
    assert kinds_in("3f2504e0-4f89-11d3-9a0c-0305e82c3301") == []
    assert kinds_in("Donaudampfschifffahrtselektrizitaetenhauptbetriebswerkbauunterbeamtengesellschaft") == []
    assert secret_scan.find([f"send {key} now"], allowed=(re.escape(key),))[0] == []


def test_an_added_span_within_a_base_span_is_left_out():
    rng = random.Random(6)
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    assert kinds_in(f"token: {key}") == ["assign"]


def test_long_texts_take_linear_time():
    began = time.time()
    assert secret_scan.find(["a" * 3_000_000])[0] == [(0, 2, 3_000_000, None)]
    assert secret_scan.find(["token" + " " * 2_000_000 + "x", "token " * 400_000]) == [[], []]
    assert len(secret_scan.find(["ab1X" * 500_000])[0]) == 0
    assert time.time() - began < 60


def test_secret_rows(spark, nasty, empty):
    assert secret_scan.scan(nasty).count() == nasty.count() and secret_scan.scan(empty).count() == 0
    rows = spark.createDataFrame([(1, "password=hunter2hunter2"), (1, "password=hunter2hunter2"), (2, None), (None, "AKIA" + "Z" * 12)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in secret_scan.scan(rows).collect())
    assert got == [(0, [("access", 0, 16)]), (1, [("assign", 0, 23)]), (1, [("assign", 0, 23)]), (2, [])]


def test_secret_query_equals_the_plain_expressions(spark):
    documents = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in queries.op13_secrets(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == documents.count()
    some = 0
    for doc_id, text in documents.select("doc_id", "text").collect():
        base = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in plain(text or "")]
        assert got[doc_id]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[doc_id][f"n_{k}"] for k in secret_scan.BASE_KINDS] == [sum(b.startswith(k) for b in base) for k in secret_scan.BASE_KINDS]
        assert set(base) <= set(got[doc_id]["spans"].split(",")) or not base
        some += len(base)
    assert some
