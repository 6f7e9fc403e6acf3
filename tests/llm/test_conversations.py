"""Structure repair of conversations against a plain search over edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from tracewell.llm import conversations, queries

WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation, from all ways to edit it."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        found = WORD.findall(text)
        faults.append("b" if not found else "d" if (role, text) in seen else "t" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    form = re.compile(r"(s?(ua)*|s?(ua)*u)$")

    @functools.cache
    def least(i, roles, inserted):
        """(cost, audit, lines) from row i on, given the last roles made; a state is told by whether roles may go on."""
        ways = [(0, "", ())] if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) else []
        if inserted < 3:
            for r in ("user", "assistant"):
                if form.match(roles + r[0]):
                    c, a, t = least(i, shorten(roles + r[0]), inserted + 1)
                    ways.append((c + 5, "I" + a, (r + ":", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = least(i + 1, roles, 0)
            ways.append((c + 2, "D" + a, t))
            if faults[i] not in ("b", "d"):
                for kind, new in (("K", role), ("R", "user"), ("R", "assistant")):
                    if new and form.match(roles + new[0]):
                        c, a, t = least(i + 1, shorten(roles + new[0]), 0)
                        ways.append((c + (kind == "R") + 5 * (faults[i] == "t"), kind + a, (f"{new}:{text}", *t)))
        return min(ways, default=(1 << 40, "", ()))

    def shorten(roles):
        return re.sub("(ua)+", "ua", roles)

    cost, audit, lines = least(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows[:-1], rows[1:], strict=True))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows, ids=()):
    by = {c: [] for c in ids}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    return {c: plain_repair(r) for c, r in by.items()}


def random_rows(seed, conversations_, most):
    rng = random.Random(seed)
    role = lambda: rng.choice(["user"] * 6 + ["assistant"] * 6 + ["system", "tool", "u", "", None])
    text = lambda: rng.choice(["Hello.", "Yes!", "no", " \t\n", "", None, "Why?  ", "é.", "🎉", "x" * 50 + "."] + [f"{rng.random()}." for _ in range(10)])
    return [(c, rng.choice([t, t, t, t + 1, None]), role(), text()) for c in conversations_ for t in range(rng.randint(1, most))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, pos int").repartition(5)


def repaired(df, ids=None):
    return {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(df, ids).collect()}


@pytest.mark.parametrize("bits", (16, 1))
def test_repair_equals_the_plain_search(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", bits)
    rows = random_rows(bits, [*range(120), None], 9) + random_rows(7, [500], 60)
    got = repaired(frame(spark, rows))
    assert got == plain(rows)
    assert all(any(edit in r[6] for r in got.values()) for edit in "DKR")  # a deletion is cheaper than an insertion


def test_damage_and_conversations_without_rows(spark):
    rows = [r for r in random_rows(9, range(200), 3) if r[1] is not None] + [(None, None, None, None), (None, 3, "user", "Hi.")]
    df = frame(spark, rows)
    got = sorted(map(repr, conversations.damage(df).collect()))
    assert [re.sub(r"^Row", "", g) for g in got] == sorted(f"(conv_id={c}, turn={t}, role={r!r}, text={x!r})" for c, t, r, x in plain_damage(rows))
    want = plain(plain_damage(rows), {r[0] for r in rows})
    assert repaired(conversations.damage(df), df) == want
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert sum(w == nothing for w in want.values()) > 0


def test_one_conversation_of_many_rows_in_many_segments(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 6)
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{t} {rng.random()}{rng.choice('.!x')}") for t in range(3000)]
    got = repaired(frame(spark, rows))[1]
    # the same in one segment
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 16)
    assert repaired(frame(spark, rows))[1] == got
    assert len(got[6]) >= 3000 and got[0] == 0


def test_repair_of_odd_rows(spark):
    assert repaired(frame(spark, [])) == {}
    assert repaired(frame(spark, []), frame(spark, [(4, 1, "user", "a.")])) == {4: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    huge = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    assert repaired(frame(spark, huge))[1][0] == (1 << 63) - 1
    long = [(1, 0, "user", "z" * 5_000_000 + "."), (1, 1, "assistant", "y" * 5_000_000 + " " * 1_000_000)]
    assert repaired(frame(spark, long)) == plain(long)
    same = [(1, 1, "user", "a.")] * 4 + [(1, 1, "assistant", "a.")]
    assert repaired(frame(spark, same)) == plain(same)


def test_distances_are_the_least_costs_and_walks_follow_tight_arcs():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice(["s", "u", "a", ""]), rng.randint(0, 3)) for _ in range(rng.randint(1, 7))]
        exits = tuple(rng.randint(0, 12) for _ in range(4))
        cost = distances_by_relaxing(rows, exits)
        assert conversations.distances(rows, exits) == cost
        m = conversations.matrix(rows)
        assert [min(m[4 * q + r] + exits[r] for r in range(4)) for q in range(4)] == cost[0]


def distances_by_relaxing(rows, exits):
    n, far = len(rows), conversations.FAR
    cost = [[far] * 4 for _ in rows] + [list(exits)]
    for _ in range(4 * n):
        for i in range(n):
            for q in range(4):
                ways = [c + cost[i + 1][r] for _, s, r, c in conversations.ARCS[rows[i]] if s == q] + [5 + cost[i][conversations.MADE[q]]]
                cost[i][q] = min(cost[i][q], *ways)
    return cost


def test_repair_query_equals_the_plain_search(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_repair(spark, sf_dir).collect()}
    assert got == plain(plain_damage(rows), {r[0] for r in rows})


def test_a_walk_inserts_where_that_is_cheapest():
    rows, exits = [("a", conversations.FINE)], (100, 100, 100, 0)
    assert conversations.walk(rows, conversations.distances(rows, exits), conversations.NOTHING) == (["IuK"], conversations.ASSISTANT)
