"""Best-fit packing of token sequences: a configuration program over the length histogram.

Multiplicative weights solve the program, a knapsack over the weights names the next patterns, and their amounts are
rounded down as they are added, so that the weights follow whole amounts. What full patterns don't cover goes through knapsacks in
whole amounts, and the last few pieces through best fit. Only the histogram, at
most one entry for each length up to the capacity, comes to the driver; documents find their places by their rank
among the pieces of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.llm import text as tx
from tracewell.llm.store import buckets_for, written

CAPACITY = 1024
END_ID = 2
#: Rows that one task ranks at a time, about.
ROWS_PER_BUCKET = 20_000
#: Sequences' worth of tokens in each range of an order that has to be kept, and ranges whose sizes are summed together.
RANGE, RANGES_PER_GROUP = 256, 4096
#: How the public byte-level vocabulary splits a text into words before merging (a fixed value of its format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"

#: A text with a longer run without white space, or of one kind of it, goes to the slower library, which doesn't take quadratic time there.
LONG_RUN = 4_096

_encoders: dict[str, Encoder] = {}


def byte_marks() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, equal to those that ``tokenizers`` gives for the vocabulary file.

    The file's vocabulary, whose ids are the ranks of its merges, is handed to ``tiktoken``, which is four times as
    fast; texts with the special token or with very long runs are encoded by ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        marks = byte_marks()
        ranks = {bytes(marks[ch] for ch in word): k for word, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if word != SPECIAL}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        long = len(text) > LONG_RUN and (any(ch * LONG_RUN in text for ch in " \n\t\r") or max(map(len, text.split()), default=0) > LONG_RUN)
        if long or SPECIAL in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): texts as ids with an end id, cut only where longer than ``capacity``.

    Of a cut document the first piece is the short one. A null or empty text is its end id alone. The columns named in
    ``keep`` follow, repeated for each piece.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for part in tx.slices(batch, "text"):
                out, row = [], []
                for at, (doc, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)):
                    ids = coder.encode(text or "") + end
                    n = len(ids) // 4
                    cut = n % capacity or capacity
                    bounds = [0, *range(cut, n + 1, capacity)]
                    out += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
                    row += [at] * (len(bounds) - 1)
                own = [pa.array([r[i] for r in out], type=t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*own, *(part.column(c).take(pa.array(row, type=pa.int64())) for c in keep)], names=["doc_id", "piece", "start", "length", "ids_crc32", *keep])

    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema) if keep else ""
    return docs.select("doc_id", "text", *keep).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + kept)


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on a histogram: (lengths in a sequence, number of such sequences)."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(count, reverse=True):
        left = count[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        group = open_.setdefault(capacity - k * length, {})
                        group[(length,) * k] = group.get((length,) * k, 0) + n
                break
            pattern, n = open_[room].popitem()
            take = min(n, left)
            if n > take:
                open_[room][pattern] = n - take
            elif not open_[room]:
                del open_[room]
            group = open_.setdefault(room - length, {})
            key = (*pattern, length)
            group[key] = group.get(key, 0) + take
            left -= take
    return [(p, n) for group in open_.values() for p, n in group.items()]


#: Pieces that are left to best fit, at most.
FEW = 8
#: In the last knapsacks, how much more a piece as long as the capacity is worth than its length: short pieces are easier to place later.
LONG_WORTH = 0.3
#: The program's settings: how fast a length's weight grows with the share of its pieces placed, how far above the cheapest
#: pattern of a round others may be, and how much cheaper than its length a piece as long as the capacity is at first.
SETTINGS = ((0.2, 0.02, 0.3), (0.1, 0.01, 0.6))
#: The share of what the pieces left allow that a round gives to a pattern.
STEP = 0.5

Patterns = list[tuple[tuple[int, ...], int]]


def solve(count: dict[int, int], capacity: int = CAPACITY, settings: tuple[tuple[float, float, float], ...] = SETTINGS) -> Patterns:
    """(lengths in a sequence, number of such sequences) for a histogram of lengths.

    The configuration program places what it can under each of the settings, knapsacks in whole amounts the rest, best fit the last
    FEW pieces. The fewest sequences count; of equal ones those of which the program placed the most.
    """
    whole = count.get(capacity, 0)
    count = {k: n for k, n in count.items() if n and k < capacity}
    out: Patterns = [((capacity,), whole)] if whole else []
    if not count:
        return out
    found = []
    for rate, tolerance, discount in settings:
        placed, left = program(count, capacity, rate, tolerance, discount)
        rest, few = by_knapsacks(left, capacity)
        every = placed + rest + best_fit(few, capacity)
        found.append((sum(n for _, n in every), -sum(len(p) * n for p, n in placed), every))
    return out + min(found, key=lambda f: f[:2])[2]


def through_program(count: dict[int, int], capacity: int = CAPACITY, setting: tuple[float, float, float] = SETTINGS[0]) -> tuple[Patterns, dict[int, int]]:
    """(patterns of the program and of the knapsacks after it, the last FEW pieces)."""
    placed, left = program(count, capacity, *setting)
    rest, few = by_knapsacks(left, capacity)
    return placed + rest, few


def lower_bound(count: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: the value of the program's dual at prices of length / capacity, which no pattern exceeds, rounded up."""
    return -(-sum(k * n for k, n in count.items()) // capacity)


def by_knapsacks(count: dict[int, int], capacity: int) -> tuple[Patterns, dict[int, int]]:
    """(patterns, the last FEW pieces): sequences filled from the longest piece on, in whole amounts."""
    left = {k: n for k, n in count.items() if n}
    out: Patterns = []

    def place(key: tuple[int, ...], most: int) -> int:
        times = {k: key.count(k) for k in set(key)}
        n = min(most, *(left.get(k, 0) // t for k, t in times.items()))
        if n > 0:
            out.append((key, n))
            for k, t in times.items():
                left[k] -= n * t
        return n

    while sum(left.values()) > FEW:
        fill = knapsack(left | {max(left): left[max(left)] - 1}, capacity)  # so that the longest piece always finds its place
        for length in sorted(left, reverse=True):
            if left[length] and not place(tuple(sorted((length, *fill(capacity - length)), reverse=True)), left[length]):
                break  # its pieces have gone to longer ones: ask again
        left = {k: n for k, n in left.items() if n}
    return out, left


def knapsack(count: dict[int, int], capacity: int):
    """A function from a room to the lengths that fill it best, none used more often than it occurs; long pieces are worth more for their length, since short ones are easier to place later."""
    items = []
    for length in sorted(count):
        left, k = min(count[length], capacity // length), 1
        while left:
            k = min(k, left)
            items.append((length, k))
            left -= k
            k *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), dtype=bool)
    for row, (length, k) in enumerate(items):
        size = length * k
        value = best[: capacity + 1 - size] + size * (1 + LONG_WORTH * length / capacity)
        better = value > best[size:]
        taken[row, size:] = better
        best[size:][better] = value[better]

    def fill(room: int) -> list[int]:
        out = []
        for row in range(len(items) - 1, -1, -1):
            if taken[row, room]:
                out += [items[row][0]] * items[row][1]
                room -= items[row][0] * items[row][1]
        return out

    return fill


def program(count: dict[int, int], capacity: int = CAPACITY, rate: float = SETTINGS[0][0], tolerance: float = SETTINGS[0][1], discount: float = SETTINGS[0][2]) -> tuple[Patterns, dict[int, int]]:
    """(patterns with whole amounts, pieces left): the configuration program by multiplicative weights.

    As a packing program: as many sequences as possible of full patterns, whose lengths sum to the capacity, without more
    pieces of a length than there are. These are the patterns that cost nothing at the dual prices of ``lower_bound``, so what it places
    is never more than an optimum needs for the same pieces. Each length has a weight that grows exponentially with the share of its pieces
    that are placed, from the length itself less the ``discount`` of long ones, which are harder to place later. A
    knapsack over the weights names, for every length, the cheapest full pattern that has it. Those within ``tolerance`` of
    the cheapest of all get STEP of what the pieces left allow, rounded down, but at least one sequence. It ends
    when no such pattern fits the pieces left.
    """
    lengths = np.array(sorted(count), dtype=np.int64)
    need = np.array([count[k] for k in lengths.tolist()], dtype=np.int64)
    left, start = need.copy(), lengths / capacity * (1 - discount * lengths / capacity)
    place = {k: i for i, k in enumerate(lengths.tolist())}
    amount: dict[tuple[int, ...], int] = {}
    while (left > 0).any():
        open_ = left > 0
        own, weight = lengths[open_], (start * np.exp(rate * (1 - left / need)))[open_]
        cost, last = np.full(capacity + 1, np.inf), np.zeros(capacity + 1, dtype=np.int64)
        cost[0] = 0.0
        for c in range(int(own[0]), capacity + 1):
            n = np.searchsorted(own, c, side="right")
            value = weight[:n] + cost[c - own[:n]]
            k = int(value.argmin())
            cost[c], last[c] = value[k], own[k]
        total = weight + cost[capacity - own]
        used = False
        for k in np.argsort(total, kind="stable"):
            if not total[k] <= total.min() * (1 + tolerance) or total[k] == np.inf:
                break
            pattern, c = [int(own[k])], int(capacity - own[k])
            while c:
                pattern.append(int(last[c]))
                c -= pattern[-1]
            key = tuple(sorted(pattern, reverse=True))
            index, times = np.unique([place[x] for x in key], return_counts=True)
            room = int((left[index] // times).min())
            if room:
                more = max(1, int(STEP * room))
                amount[key] = amount.get(key, 0) + more
                left[index] -= more * times
                used = True
        if not used:
            break
    return list(amount.items()), {int(k): int(n) for k, n in zip(lengths, left, strict=True) if n}


class Places:
    """Where the piece of a given length and rank goes: for each length the ranks at which its next pattern begins."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        base = 0
        for pattern, n in patterns:
            offset = 0
            for length in dict.fromkeys(pattern):
                times = pattern.count(length)
                rows.setdefault(length, []).append((ranks.get(length, 0), times, base, offset))
                ranks[length] = ranks.get(length, 0) + times * n
                offset += times * length
            base += n
        self.rows = {k: np.array(v, dtype=np.int64) for k, v in rows.items()}
        self.sequences = base

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            at = np.flatnonzero(length == k)
            table = self.rows[int(k)]
            row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
            local = rank[at] - row[:, 0]
            sequence[at] = row[:, 2] + local // row[:, 1]
            offset[at] = row[:, 3] + local % row[:, 1] * k
        return sequence, offset


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Sequences are numbered from 0 and filled without gaps. Rows with one doc_id, or none, are documents of their
    own. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    cut = written(pieces(docs, tokenizer, capacity, end_id), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(solve(histogram, capacity))
    buckets = buckets_for(sum(histogram.values()), ROWS_PER_BUCKET)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    local = keyed.withColumn("row", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = local.join(starts, ["length", "bucket"]).select(*cut.columns, (F.col("row") + F.col("first")).alias("rank"))

    def run(batches):
        for batch in batches:
            sequence, offset = places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def running(sizes: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """(groups, order, first) of (groups, order, n): the sum of ``n`` before each row in the order of groups and rows.

    One task sums up the groups, of which there are far fewer than rows; within a group its own rows are added.
    """
    own = F.coalesce(F.sum("n").over(W.partitionBy(*groups).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = sizes.groupBy(*groups).agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(W.partitionBy(F.lit(1)).orderBy(*groups).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("own", own).join(totals.select(*groups, before.alias("before")), groups).select(*groups, *order, (F.col("before") + F.col("own")).alias("first"))


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, file, row): the documents with their place, by file and row where they come from files, else by row of the frame."""
    try:
        return docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))


def pack_in_order(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, sequences: int = RANGE) -> DataFrame:
    """As ``pack``, but sequences follow the order of the documents.

    The order is cut into ranges of ``sequences`` times ``capacity`` tokens. Each is packed by itself as by ``pack``, and
    within it sequences are numbered by the mean place of their tokens, so that the first sequences hold the first
    documents to within one range.
    """
    cut = written(pieces(in_order(docs), tokenizer, capacity, end_id, keep=("file", "row")), "packing-pieces")
    keyed = cut.withColumn("chunk", F.floor(F.col("row") / ROWS_PER_BUCKET))
    starts = running(keyed.groupBy("file", "chunk").agg(F.sum("length").alias("n")), ["file"], ["chunk"])
    before = F.sum("length").over(W.partitionBy("file", "chunk").orderBy("row", "piece").rowsBetween(W.unboundedPreceding, -1))
    place = keyed.withColumn("before", F.coalesce(before, F.lit(0))).join(starts, ["file", "chunk"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranged = place.select(*names, (F.col("first") + F.col("before")).alias("place")).withColumn("range", F.floor(F.col("place") / (sequences * capacity)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place", ignore_index=True)
        length = part["length"].to_numpy()
        places = Places(solve(part["length"].value_counts().to_dict(), capacity))
        sequence, offset = places(length, part.groupby("length").cumcount().to_numpy())
        mean = np.bincount(sequence, weights=length * (part["place"].to_numpy() - part["place"].iat[0])) / np.bincount(sequence, weights=length)
        number = np.argsort(np.argsort(mean, kind="stable"), kind="stable")
        return part.drop(columns="place").assign(local=number[sequence], offset=offset)

    packed = written(ranged.groupBy("range").applyInPandas(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, range bigint, local bigint, offset bigint"), "packing-ranges")
    sizes = packed.groupBy("range").agg((F.max("local") + 1).alias("n")).withColumn("group", F.floor(F.col("range") / RANGES_PER_GROUP))
    first = running(sizes, ["group"], ["range"]).select("range", "first")
    return packed.join(first, "range").select(*names, (F.col("first") + F.col("local")).alias("sequence_id"), "offset")
