"""Structure repair of conversations: cheapest edits by Dial's bucket queue, over segments of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.store import written

#: Rows of a segment: 2**16, so a conversation of ten thousand million rows has 150,000 of them.
SEGMENT_BITS = 16

#: A repaired conversation is in one of these states after each turn; it may end in the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: States after a turn that a rerole or an insertion makes, and after a kept turn by its role's initial.
MADE = (USER, USER, ASSISTANT, USER)
KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
FAR = 1 << 60

#: A row's first fault.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")


def _arcs(initial: str, fault: int) -> list[tuple[str, int, int, int]]:
    """(edit, state, state after it, cost) over a row, in the order of the edits' initials. Capitals are edits, small letters roles made."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = UNFINISHED * (fault == TRUNCATED)
        out += [("K", q, r, more) for (c, q), r in KEPT.items() if c == initial]
        out += [("R" + ROLES[MADE[q]][0], q, MADE[q], REROLE + more) for q in range(4)]
    return out


_INITIALS = ("s", "u", "a", "")
ARCS = {(c, f): _arcs(c, f) for c in _INITIALS for f in range(4)}
#: For each state those (state before, cost) that lead to it over a row, and by an insertion.
BACK = {k: [[(q, cost) for _, q, r, cost in arcs if r == to] for to in range(4)] for k, arcs in ARCS.items()}
BACK_INSERTED = [[q for q in range(4) if MADE[q] == to] for to in range(4)]
FORWARD = {k: [[(edit, r, cost) for edit, at, r, cost in arcs if at == q] for q in range(4)] for k, arcs in ARCS.items()}

#: At a conversation's end: what insertions complete it from each state.
TAIL = ("", "IuIa", "Ia", "")
END = tuple(INSERT * (len(t) // 2) for t in TAIL)


def distances(rows: list[tuple[str, int]], exits: tuple[int, ...]) -> list[list[int]]:
    """Least cost from each state before each row, and after the last, to the exits, which cost ``exits`` by state.

    Dial's queue: costs are small whole numbers, so there is a bucket for each distance and no heap. An insertion after
    the last row belongs to what follows.
    """
    n = len(rows)
    base = min(exits)
    out = [[FAR] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(max((e for e in exits if e < FAR), default=base) - base + DELETE * n + 2 * INSERT + 2)]
    top = len(buckets)
    for q, e in enumerate(exits):
        if e < FAR:
            out[n][q] = e
            buckets[e - base].append((n, q))
    for d in range(top):
        now = d + base
        for i, to in buckets[d]:  # grows by arcs without cost
            if out[i][to] != now:
                continue  # reached more cheaply since
            if i:
                before = out[i - 1]
                for q, cost in BACK[rows[i - 1]][to]:
                    if now + cost < before[q] and d + cost < top:
                        before[q] = now + cost
                        buckets[d + cost].append((i - 1, q))
            if i < n:
                here = out[i]
                for q in BACK_INSERTED[to]:
                    if now + INSERT < here[q] and d + INSERT < top:
                        here[q] = now + INSERT
                        buckets[d + INSERT].append((i, q))
    return out


def walk(rows: list[tuple[str, int]], cost: list[list[int]], state: int) -> tuple[list[str], int]:
    """The edits of each row, insertions before it among them, and the state after the last: along tight arcs, least initial first."""
    out = []
    for i, row in enumerate(rows):
        edits = ""
        while True:
            here, after = cost[i][state], cost[i + 1]
            inserted = MADE[state]
            tight = [(edit, to) for edit, to, c in FORWARD[row][state] if c + after[to] == here]
            if cost[i][inserted] + INSERT == here:
                tight.append(("I" + ROLES[inserted][0], inserted))
            edit, to = min(tight)
            edits, state = edits + edit, to
            if edit[0] != "I":
                break
        out.append(edits)
    return out, state


def matrix(rows: list[tuple[str, int]]) -> list[int]:
    """Least cost from each state before the rows to each state after them, row by row."""
    columns = [distances(rows, tuple(0 if q == r else FAR for q in range(4)))[0] for r in range(4)]
    return [columns[r][q] for q in range(4) for r in range(4)]


def runs(keys: list) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal keys."""
    cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return [(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]


def _edges(part: pd.DataFrame) -> pd.DataFrame:
    """The first and the last conversation of a segment, which may go on in others."""
    part = part.sort_values("pos")
    keys, rows = part["key"].tolist(), list(zip(part["initial"], part["fault"], strict=True))
    found = runs(keys)
    at = sorted({found[0], found[-1]})
    return pd.DataFrame({"key": [keys[a] for a, _ in at], "seg": part["seg"].iat[0], "costs": [matrix(rows[a:b]) for a, b in at], "first": [rows[a][0] for a, _ in at], "last": [rows[b - 1][0] for _, b in at]})


def _exits(part: pd.DataFrame) -> pd.DataFrame:
    """What a conversation's rest costs after each of its segments, from the last one backwards; nothing for a single one."""
    part = part.sort_values("seg", ignore_index=True)
    n = len(part)
    exits = [END] * n
    for k in range(n - 1, 0, -1):
        m = part["costs"].iat[k]
        exits[k - 1] = tuple(min(FAR, *(int(m[4 * q + r]) + exits[k][r] for r in range(4))) for q in range(4))
    out = pd.DataFrame({"key": part["key"], "seg": part["seg"], "exits": [list(e) for e in exits], "before": [None, *part["last"].tolist()[:-1]], "place": [0, *[1] * (n - 2), 2][:n]})
    return out if n > 1 else out.iloc[:0]


def _edits(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Each row's edits: one entry where the state before its segment is known, else one for each state."""
    if not len(part):
        return pd.DataFrame(columns=[c.split()[0] for c in EDITS.split(", ")], dtype=object)
    part = part.sort_values("pos", ignore_index=True)
    keys, rows = part["key"].tolist(), list(zip(part["initial"], part["fault"], strict=True))
    edges = {k: (tuple(int(x) for x in e), before, place) for k, e, before, place in zip(known["key"], known["exits"], known["before"], known["place"], strict=True)}
    edits, after, costs, illegal = [], [None] * len(rows), [None] * len(rows), []
    for a, b in runs(keys):
        exits, before, place = edges.get(keys[a], (END, None, None))
        own = rows[a:b]
        cost = distances(own, exits)
        ways = [walk(own, cost, q) for q in (range(4) if place in (1, 2) else (NOTHING,))]
        if place in (None, 2):
            for w, state in ways:
                w[-1] += TAIL[state]
        if place in (None, 0):
            costs[a] = cost[0][NOTHING]
        if place is not None:
            after[b - 1] = [state for _, state in ways]
        edits += [list(e) for e in zip(*(w for w, _ in ways), strict=True)]
        initials = [before, *(c for c, _ in own)]
        illegal += [x is not None and x + y not in LEGAL for x, y in zip(initials[:-1], initials[1:], strict=True)]
    return part[["key", "seg", "pos", "fault"]].assign(edits=edits, after=after, cost=pd.array(costs, dtype="Int64"), illegal=illegal)


def _entries(part: pd.DataFrame) -> pd.DataFrame:
    """The state before each of a conversation's segments, from the first one onwards."""
    part = part.sort_values("seg", ignore_index=True)
    state, states = NOTHING, []
    for k, after in enumerate(part["after"]):
        states.append(state)
        state = int(after[state if k else 0])
    return pd.DataFrame({"key": part["key"], "seg": part["seg"], "entry": states})


EDITS = "key string, seg bigint, pos bigint, fault int, edits array<string>, after array<int>, cost bigint, illegal boolean"
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class _Conversation:
    """What is known of a conversation while its rows pass by in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.faults, self.illegal, self.cost, self.audit = conv_id, [0] * 4, 0, 0, []
        self.least = self.most = None
        self.turns, self.lines, self.hash = 0, 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def turn(self, turn: int | None) -> None:
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn

    def edit(self, edits: str, role: str, text: str) -> None:
        i = 0
        while i < len(edits):
            kind = edits[i]
            made = {"u": "user", "a": "assistant"}.get(edits[i + 1 : i + 2])
            if kind == "K":
                self.line(role, text)
            elif kind != "D":
                self.line(made, text if kind == "R" else "")
            self.audit.append(kind)
            i += 1 + (made is not None)

    def result(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, min(gaps, (1 << 63) - 1), *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation. A conversation comes as its id, then each row followed by its edits."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    made = lambda done: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
    now, key, done, size, role, text = None, None, [], 0, "", ""
    for new, pos, edits, conv_id, turn, role_, text_, fault, illegal, cost in _rows(batches):
        if new != key or now is None:
            if now is not None:
                done.append(now.result())
                size += len(now.audit) + 200
                if size > 1 << 22:
                    yield made(done)
                    done, size = [], 0
            now, key = _Conversation(conv_id), new
        if pos < 0:
            continue
        if edits is None:
            now.turn(turn)
            role, text = role_, text_
        else:
            now.edit(edits, role, text)
            now.faults[fault] += 1
            now.illegal += illegal
            now.cost += cost or 0
    if now is not None:
        done.append(now.result())
    if done:
        yield made(done)


def ordered(turns: DataFrame) -> DataFrame:
    """``turns`` with (key, pos): the conversation, and a number that grows along its rows by turn (nulls first), role, text digest.

    Rows are spread by ranges of the whole order, so a conversation with many rows has several tasks.
    """
    key = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    order = ["key", F.asc_nulls_first("turn"), "role", "digest", "row"]
    rows = turns.withColumn("key", key).withColumn("digest", F.sha2(F.col("text"), 256)).withColumn("row", F.monotonically_increasing_id())
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("pos", F.monotonically_increasing_id())


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text) and of ``conversations`` (conv_id): its faults and cheapest repair.

    ``gaps`` counts missing turn numbers; ``blank``, ``duplicate`` and ``truncated`` rows by their first fault; ``illegal``
    pairs of neighbours; ``cost`` is that of the cheapest edits, ``audit`` their initials (Delete, Insert, Keep, Rerole; of
    equally cheap ones the ASCII-least), ``repaired_sha256`` the digest of the repaired lines.

    A null role or text counts as one space, null turns come first, a null conv_id is a conversation of its own. Rows
    of one turn follow each other by role, then by the text's SHA-256; equal rows are duplicates. A conversation without rows has zeros,
    an empty audit and the empty digest. Other columns are not read.

    Costs of segments of at most 2**16 rows are found apart and joined as 4 by 4 matrices, and so are the walks along tight
    arcs, one for each state before a segment. Only the digest, whose definition is a chain over all lines, reads a whole
    conversation in one task: as a stream, in order, without holding it.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    ids = (turns if conversations is None else conversations).select(F.col("conv_id").cast("long").alias("conv_id"))
    rows = written(ordered(rows), "conversation-rows")

    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(shown == "", BLANK).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    slim = rows.select("key", "pos", "role", "digest", F.when(initial.isin(*_INITIALS), initial).otherwise("").alias("initial"), fault.alias("fault"))
    first = slim.where(F.col("fault") != BLANK).groupBy("key", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    judged = slim.join(first, "pos", "left").select(
        "key", "pos", F.shiftright("pos", SEGMENT_BITS).alias("seg"), "initial", F.when(F.col("new").isNull() & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")).alias("fault")
    )
    judged = written(judged, "conversation-faults")

    edges = judged.groupBy("seg").applyInPandas(_edges, "key string, seg bigint, costs array<bigint>, first string, last string")
    exits = edges.groupBy("key").applyInPandas(_exits, "key string, seg bigint, exits array<bigint>, before string, place int")
    edits = written(judged.groupBy("seg").cogroup(exits.groupBy("seg")).applyInPandas(_edits, EDITS), "conversation-edits")
    entries = edits.where("after is not null").groupBy("key").applyInPandas(_entries, "key string, seg bigint, entry int")
    chosen = edits.join(entries, ["key", "seg"], "left").select("key", "pos", F.col("edits")[F.when(F.size("edits") > 1, F.coalesce("entry", F.lit(0))).otherwise(0)].alias("edits"), "fault", "illegal", "cost")

    none: dict[str, Column] = {c: F.lit(None).cast(t) for c, t in (("edits", "string"), ("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"), ("fault", "int"), ("illegal", "boolean"), ("cost", "long"))}
    key = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    shaped = lambda df, **have: df.select("key", "pos", *(have.get(c, none[c]).alias(c) for c in none))
    starts = shaped(ids.distinct().select(key.alias("key"), F.lit(-1).cast("long").alias("pos"), "conv_id"), conv_id=F.col("conv_id"))
    lines = shaped(rows, conv_id=F.col("conv_id"), turn=F.col("turn"), role=F.col("role"), text=F.col("text"))
    marks = shaped(chosen, **{c: F.col(c) for c in ("edits", "fault", "illegal", "cost")})
    stream = starts.union(lines).union(marks).repartition("key").sortWithinPartitions("key", "pos", F.col("edits").isNotNull())
    return stream.mapInArrow(_results, RESULT)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text; nulls count as one space) with faults set by a checksum of conversation and turn.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes its stops away, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
