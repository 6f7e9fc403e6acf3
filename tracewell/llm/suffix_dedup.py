"""Exact substring deduplication by a sparse, distributed suffix array.

A 100-byte string holds an anchor: the place in it whose next 20 bytes have the smallest hash. Equal strings have
their anchors at the same place, so only suffixes at anchors are sorted, about one byte in forty.

1. Every anchor stands for the windows (100-byte strings) around it, and these cover a region. Blocks of the input sort
   their own regions by their bytes; those equal to an earlier one are covered. The others send a hash of their leading
   bytes, which only tells leading bytes that occur once, and so can't repeat, from the rest.
2. The rest, with their regions' bytes, are range-partitioned by their leading bytes, with splitters that Spark samples.
   A bucket sorts regions, and then the windows of distinct ones, by multikey quicksort, eight bytes at a time, and
   keeps the first of equal ones. Leading bytes that occur very often are cut into parts of bounded size, which may lie in
   several buckets; these are compared across their boundaries: each part sends its distinct windows with their first
   places, and learns the first places of all parts.
3. Each document unites what was covered and drops it.

Bytes decide what is covered, hashes only what is compared. Texts are worked on in blocks, whatever their length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import text as tx
from tracewell.llm.jaccard import group_starts, whole_groups
from tracewell.llm.store import buckets_for, delete_written, written

WINDOW = 100
LEADING = 20
#: Suffixes with one leading text that a task sorts together, about; more are cut into parts.
PART_ROWS = 16_384
#: Suffixes of a range of leading texts, about.
RANGE_ROWS = 150_000
#: Bytes of text, or window starts of a longer one, that are worked on at a time.
BLOCK = 1 << 19
#: Bytes that regions of a block's windows may lie beyond it; a region has less than 256.
OVERHANG = 256
_U = np.uint64


def anchors(buf: np.ndarray, off: np.ndarray, window: int = WINDOW, leading: int = LEADING):
    """(document, anchor, first window, last window) as byte positions; windows cross no document and are told apart by their anchor alone."""
    none = np.zeros(0, dtype=np.int64)
    n = len(buf)
    if n < window:
        return none, none, none, none
    sums = tx.prefix(buf)
    at = np.arange(n - leading + 1)
    h = tx.spans(sums, at, at + leading)
    low = (h & _U(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # ties go to the leftmost
    span, done = window - leading + 1, 1
    while done * 2 <= span:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    low = np.minimum(low[: len(low) - (span - done)], low[span - done :])
    starts = np.arange(n - window + 1)
    doc = np.searchsorted(off, starts, side="right") - 1
    ok = starts + window <= off[doc + 1]
    starts, doc, chosen = starts[ok], doc[ok], (low[: n - window + 1][ok] & _U(0xFFFFFFFF)).astype(np.int64)
    if not len(starts):
        return none, none, none, none
    cut = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.append(cut[1:], len(starts)) - 1
    return doc[cut], chosen[cut], starts[cut], starts[last]


def blocks(buf: np.ndarray, off: np.ndarray, window: int):
    """(bytes, offsets, place of the first byte) of blocks; every window starts in one of them."""
    for low in range(0, max(len(buf) - window + 1, 0), BLOCK):
        high = min(len(buf), low + BLOCK + window - 1)
        yield buf[low:high], np.clip(off, low, high) - low, low


def anchor_rows(docs: DataFrame, window: int, leading: int) -> DataFrame:
    """(lead, doc, place, end): hashes of leading bytes and where they stand, and, without ``lead``, ranges that are covered.

    ``place`` packs the anchor, its distance from the first window, and the number of windows; of a covered range it is
    the start. Of equal regions in one block of the input only the first goes on; the others are covered.
    """

    def of_block(buf, off, base, ids, starts):
        doc, at, first, last = anchors(buf, off, window, leading)
        if not len(at):
            return
        lead = tx.spans(tx.prefix(buf), at, at + leading)
        back, many = at - first, last - first + 1
        ids, origin = ids[doc], base - starts[doc]  # places count from the document's first byte
        place = pack(at + origin, back, many)
        order = np.lexsort((many, back, lead))
        kind = np.cumsum(np.concatenate(([0], (lead[order][1:] != lead[order][:-1]) | (back[order][1:] != back[order][:-1]) | (many[order][1:] != many[order][:-1]))))
        code = np.empty(len(at), dtype=np.int64)
        code[order] = kind
        order, segment = multikey_sort(buf, first, code, many - 1 + window)
        covered = np.zeros(len(at), dtype=bool)
        best = np.lexsort((place[order], ids[order], segment))
        order, segment = order[best], segment[best]
        begin = order[group_begins(segment)]
        covered[order] = (ids[order] != ids[begin]) | (place[order] != place[begin])  # the row itself, repeated, doesn't cover itself
        own, start, end = united(ids[covered], (first + origin)[covered], (last + origin)[covered] + window)
        open_ = ~covered
        yield pa.RecordBatch.from_arrays([pa.array(lead[open_].view(np.int64)), pa.array(ids[open_]), pa.array(place[open_]), pa.nulls(int(open_.sum()), pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.array(own), pa.array(start), pa.array(end)], names=names)

    names = ["lead", "doc", "place", "end"]

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text", BLOCK):
                buf, off = tx.texts(part.column("text"))
                ids = part.column("doc").to_numpy()
                for own, own_off, base in blocks(buf, off, window):
                    yield from of_block(own, own_off, base, ids, off)

    return docs.mapInArrow(run, "lead bigint, doc bigint, place bigint, end bigint")


def group_begins(segment: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the place where its run of equal values begins."""
    fresh = np.concatenate(([True], segment[1:] != segment[:-1]))[: len(segment)]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(segment)), 0))


def united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of at least a window's length, those that overlap or touch made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    cut = np.concatenate(([True], doc[1:] != doc[:-1]))
    reach = end + np.cumsum(cut) * (1 << 42)  # keeps the running maximum within a document
    top = np.maximum.accumulate(reach)
    cut[1:] |= start[1:] + np.cumsum(cut)[1:] * (1 << 42) > top[:-1]
    at = np.flatnonzero(cut)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def pack(anchor: np.ndarray, back: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return anchor << 16 | back << 8 | windows


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, place >> 8 & 255, place & 255


def repeated(rows: DataFrame) -> DataFrame:
    """(doc, block, places): the anchors, with the parts of their leading text, whose leading bytes occur more than once."""
    leads = rows.where("lead is not null").select("lead", "doc", "place")
    many = leads.groupBy("lead").agg(F.count("*").alias("many")).where("many > 1")
    parts = F.ceil(F.col("many") / PART_ROWS).cast("int").alias("parts")
    block = F.expr(f"(shiftright(place, 16) - (shiftright(place, 8) & 255)) div {BLOCK}").alias("block")
    known = leads.join(many, "lead").select("doc", block, "place", parts)
    return known.groupBy("doc", "block").agg(F.collect_set(F.struct("place", "parts")).alias("places"))  # bounded by a block's length


def suffixes(docs: DataFrame, window: int) -> DataFrame:
    """(l0, l1, l2, part, cut, doc, place, region): the leading bytes as numbers, the part that a place falls in, whether there are others, and the bytes that the windows cover."""

    def word(buf, at, n):
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            out = out << _U(8) | buf[at + k].astype(np.uint64)
        return pa.array((out ^ _U(1 << 63)).view(np.int64))

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text", BLOCK):
                buf, off = tx.texts(part.column("text"))
                places = part.column("places")
                row = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy())
                place, parts = (places.flatten().field(k).to_numpy() for k in ("place", "parts"))
                ids, block = part.column("doc").to_numpy()[row], part.column("block").to_numpy()[row]
                anchor, back, windows = unpack(place)
                at, size = off[row] + anchor - block * BLOCK, windows - 1 + window
                own = (tx.mix(ids.astype(np.uint64) ^ tx.mix((anchor >> 16).astype(np.uint64))) % parts.astype(np.uint64)).astype(np.int32)
                for low in range(0, len(at), PART_ROWS):
                    s = slice(low, low + PART_ROWS)
                    where = np.repeat(at[s] - back[s] - np.concatenate(([0], np.cumsum(size[s])[:-1])), size[s]) + np.arange(size[s].sum())
                    text = pa.Array.from_buffers(pa.binary(), len(at[s]), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size[s]))).astype(np.int32)), pa.py_buffer(buf[where])])
                    yield pa.RecordBatch.from_arrays(
                        [word(buf, at[s], 8), word(buf, at[s] + 8, 8), word(buf, at[s] + 16, 4), pa.array(own[s]), pa.array(parts[s] > 1), pa.array(ids[s]), pa.array(place[s]), text],
                        names=["l0", "l1", "l2", "part", "cut", "doc", "place", "region"],
                    )

    return docs.mapInArrow(run, "l0 bigint, l1 bigint, l2 bigint, part int, cut boolean, doc bigint, place bigint, region binary")


def multikey_sort(buf: np.ndarray, start: np.ndarray, segment: np.ndarray, size: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, segment in that order): strings of ``size`` bytes, equal within a segment, split by eight bytes at a time while ties last."""
    order = np.argsort(segment, kind="stable")
    segment = segment[order]
    sizes = np.broadcast_to(size, start.shape)
    for low in range(0, int(sizes.max(initial=0)), 8):
        change = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1]))[: len(segment)])
        many = np.diff(np.append(change, len(segment)))
        tied = np.flatnonzero(np.repeat(many > 1, many))
        if not len(tied):
            break
        at = start[order[tied]] + np.minimum(low, sizes[order[tied]] - 8)
        word = np.zeros(len(tied), dtype=np.uint64)
        for k in range(8):
            word = word << _U(8) | buf[at + k].astype(np.uint64)
        own = np.lexsort((word, segment[tied]))
        order[tied] = order[tied][own]
        word, held = word[own], segment[tied]
        split = np.concatenate(([False], (word[1:] != word[:-1]) & (held[1:] == held[:-1])))
        # numbers of later segments move up, order among them stays
        step = np.zeros(len(segment), dtype=np.int64)
        step[change] = 1
        step[tied[split]] = 1
        segment = np.cumsum(step)
    return order, segment


def compared(rows: DataFrame, partitions: int, window: int) -> DataFrame:
    """(doc, start, end, bytes): ranges covered by an earlier equal window, and, with their bytes, distinct windows to compare across parts."""
    most = 1 << 18

    def regions_of(table: pa.Table):
        """(ranges covered by equal regions, rows of the other regions)."""
        start = np.append(group_starts(table, KEYS), table.num_rows)
        group = np.repeat(np.arange(len(start) - 1), np.diff(start))
        doc, place = table.column("doc").to_numpy(), table.column("place").to_numpy()
        anchor, back, many = unpack(place)
        buf, off = tx.texts(table.column("region").combine_chunks())
        order, segment = multikey_sort(buf, off[:-1], group << 16 | back << 8 | many, np.diff(off))
        best = np.lexsort((place[order], doc[order], segment))
        order, segment = order[best], segment[best]
        begins = group_begins(segment)
        fresh = np.sort(order[begins == np.arange(len(begins))])
        first = order[begins]
        late = order[(doc[order] != doc[first]) | (place[order] != place[first])]
        begin = anchor[late] - back[late]
        return united(doc[late], begin, begin + many[late] - 1 + window), fresh, group

    def windows_of(table: pa.Table, rows: np.ndarray, group: np.ndarray):
        """Covered ranges, and distinct windows where the leading text has other parts."""
        cut = table.column("cut").to_numpy()
        buf, off = tx.texts(table.column("region").combine_chunks())
        kinds = np.bincount(group[rows], minlength=len(group) and group[-1] + 1)
        rows = rows[(kinds[group[rows]] > 1) | cut[rows]]  # windows of a single region stand at different distances
        doc, place = table.column("doc").to_numpy()[rows], table.column("place").to_numpy()[rows]
        anchor, back, many = unpack(place)
        group, off, cut = group[rows], off[rows], cut[rows]
        low = 0
        while low < 256 and len(rows):  # equal windows lie equally far before their anchors, so distances go one block after another
            high = low + 1
            size = ((back >= low) & (back - many < low)).sum()
            while high < 256 and size < most:
                size += ((back >= high) & (back - many < high)).sum()
                high += 1
            # windows of a row have distances back, back - 1, ..., back - many + 1
            top, bottom = np.minimum(back, high - 1), np.maximum(back - many + 1, low)
            n = np.maximum(top - bottom + 1, 0)
            row = np.repeat(np.arange(len(doc)), n)
            if len(row):
                away = np.repeat(top + np.concatenate(([0], np.cumsum(n)[:-1])), n) - np.arange(n.sum())
                at, begin = off[row] + back[row] - away, anchor[row] - away
                order, segment = multikey_sort(buf, at, group[row] * 256 + away, window)
                own_doc, own_begin = doc[row[order]], begin[order]
                best = np.lexsort((own_begin, own_doc, segment))
                order, segment, own_doc, own_begin = order[best], segment[best], own_doc[best], own_begin[best]
                lead = group_begins(segment)
                covered = (own_doc != own_doc[lead]) | (own_begin != own_begin[lead])
                yield *united(own_doc[covered], own_begin[covered], own_begin[covered] + window), None
                send = np.flatnonzero((lead == np.arange(len(lead))) & cut[row[order]])
                for a in range(0, len(send), PART_ROWS):
                    some = send[a : a + PART_ROWS]
                    text = buf[at[order[some]][:, None] + np.arange(window)]
                    size_ = pa.py_buffer((np.arange(len(some) + 1) * window).astype(np.int32))
                    yield own_doc[some], own_begin[some], own_begin[some] + window, pa.Array.from_buffers(pa.binary(), len(some), [None, size_, pa.py_buffer(text)])
            low = high

    def run(batches):
        for table in whole_groups(batches, KEYS):
            ranges, fresh, group = regions_of(table)
            for doc, begin, end, text in ((*ranges, None), *windows_of(table, fresh, group)):
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(begin), pa.array(end), pa.nulls(len(doc), pa.binary()) if text is None else text], names=["doc", "start", "end", "bytes"])

    placed = rows.repartitionByRange(partitions, *KEYS).sortWithinPartitions(*KEYS, "doc", "place")
    return placed.mapInArrow(run, "doc bigint, start bigint, end bigint, bytes binary")


KEYS = ("l0", "l1", "l2", "part")


def covered_ranges(docs: DataFrame, window: int = WINDOW, leading: int = LEADING) -> DataFrame:
    """(doc, start, end) of bytes that a window which occurs earlier covers; ``docs`` has (doc, text), a text for each doc."""
    rows = written(anchor_rows(docs, window, leading), "suffix-anchors")
    places = written(repeated(rows), "suffix-places")
    whole = written(rows.where("lead is null").select("doc", F.col("place").alias("start"), "end"), "suffix-whole")
    delete_written(docs.sparkSession, rows)  # hashes that no later step reads
    blocks_ = F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(octet_length(text) - 1, 0) div {BLOCK}"))
    cut = docs.select("doc", F.col("text").cast("binary").alias("text"), F.explode(blocks_).alias("block"))
    texts = cut.select("doc", "block", F.expr(f"substring(text, cast(block * {BLOCK} + 1 as int), {BLOCK + OVERHANG})").alias("text")).join(places, ["doc", "block"])
    many = places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    found = written(compared(suffixes(texts, window), buckets_for(many, RANGE_ROWS), window), "suffix-compared")
    delete_written(docs.sparkSession, places)
    edge = found.where("bytes is not null")
    firsts = edge.groupBy("bytes").agg(F.min(F.struct("doc", "start")).alias("first"))
    late = edge.join(firsts, "bytes").where("doc <> first.doc or start <> first.start").select("doc", "start", "end")
    return whole.union(found.where("bytes is null").select("doc", "start", "end")).union(late)


def dedup(docs: DataFrame, window: int = WINDOW, leading: int = LEADING, keep: bool = True) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept).

    A null text counts as empty. Rows with one id and one text are one document, and each is returned. Rows without
    id, and rows of an id that comes with several texts, can't be put in order: they are returned whole and cover nothing.
    ``kept`` is what remains, as bytes: a cut may fall inside a character. ``keep=False`` leaves it out. Columns other
    than doc_id and text are not read.
    """
    base = docs.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    several = base.where("doc is not null").select("doc", F.xxhash64("text").alias("h")).groupBy("doc").agg((F.min("h") != F.max("h")).alias("several")).where("several").select("doc")
    some = several.limit(1).count() > 0
    usable = base.where("doc is not null")
    usable = usable.join(several, "doc", "left_anti") if some else usable
    ranges = covered_ranges(usable, window, leading).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    joined = usable.join(ranges, "doc", "left").select("doc", "text", "ranges")
    rest = base.where("doc is null") if not some else base.where("doc is null").union(base.join(several, "doc", "left_semi"))
    every = joined.unionByName(rest.withColumn("ranges", F.lit(None).cast("array<struct<start:bigint,end:bigint>>")))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if keep else 5]

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text", BLOCK):
                buf, off = tx.texts(part.column("text"))
                found = part.column("ranges")
                cut = np.concatenate(([0], np.cumsum(found.value_lengths().fill_null(0).to_numpy())))
                start, end = (found.flatten().field(k).to_numpy() for k in ("start", "end"))
                out = []
                for k, doc in enumerate(part.column("doc").to_pylist()):
                    own, own_end = start[cut[k] : cut[k + 1]], np.maximum.accumulate(end[cut[k] : cut[k + 1]])
                    fresh = np.flatnonzero(np.concatenate(([True], own[1:] > own_end[:-1]))[: len(own)])
                    raw = memoryview(buf[off[k] : off[k + 1]])
                    last, left, digest, kept = 0, 0, hashlib.sha256(), []
                    for a, b in (*zip(own[fresh].tolist(), own_end[np.append(fresh[1:], len(own)) - 1].tolist() if len(own) else [], strict=True), (len(raw), len(raw))):
                        digest.update(raw[last:a])
                        left += a - last
                        if keep:
                            kept.append(raw[last:a])
                        last = b
                    out.append((doc, len(raw), len(raw) - left, len(fresh), digest.hexdigest(), b"".join(kept))[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(_TYPES[: len(names)])], names=names)

    types = ("bigint", "bigint", "bigint", "bigint", "string", "binary")
    return every.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=False)))


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
