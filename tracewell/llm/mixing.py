"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

A source of weight w gets one block in every window of 1/w slots: its block i (from 0) may start at slot
floor(i/w) and must end by slot ceil((i+1)/w). Earliest deadline first meets all windows, so that after any slot
each source lies less than one block from its share. Weights are whole numbers of very small quanta; all blocks are
scheduled, in time that grows with their number, and every block finds its slot by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Documents in a block.
BLOCK = 16
#: Slots in a cycle for each source; cycles only number the slots, weights aren't rounded to them.
SLOTS_PER_SOURCE = 32
#: Quanta that all weights are divided into: so many that over 2**24 blocks rounding moves a source by less than 1/1,000 block, and whole numbers stay below 2**63.
QUANTA = 2**38
#: Slots that the schedule gathers at a time.
RUN = 1024
#: Default target: shares in proportion to the number of documents to this power.
POWER = 0.5
#: Rows that one task numbers at a time, about.
ROWS_PER_BUCKET = 20_000


def default_weights(sizes: DataFrame, power: float = POWER) -> DataFrame:
    """(source, weight) from (source, n): flatter than the corpus, so that small sources are heard."""
    return sizes.select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))


def quanta(weights: DataFrame, slots_per_source: int = SLOTS_PER_SOURCE) -> DataFrame:
    """(source, q, cycle): whole quanta by largest remainders, one each at least; cycle is their sum.

    The table has a row for each source. Sources whose weight is null or not above zero get the least quantum.
    """
    clean = weights.select("source", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0).alias("weight"))
    total = clean.agg(F.sum("weight").alias("total"), F.count("*").alias("sources"))
    share = clean.crossJoin(F.broadcast(total)).select(  # one row on the right
        "source",
        (F.coalesce(F.try_divide("weight", "total"), F.lit(0.0)) * F.col("sources") * (slots_per_source - 1)).alias("ideal"),
        (F.col("sources") * (slots_per_source - 1)).alias("spare"),
    )
    floored = share.select("source", "ideal", "spare", F.floor("ideal").alias("whole"))
    every = W.partitionBy(F.lit(1))
    ranked = floored.select(
        "source",
        "whole",
        (F.col("spare") - F.sum("whole").over(every)).alias("left"),
        F.row_number().over(every.orderBy((F.col("whole") - F.col("ideal")), "source")).alias("place"),
    )
    got = ranked.select("source", (F.col("whole") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0) + 1).cast("long").alias("q"))
    return got.select("source", "q", F.sum("q").over(W.partitionBy(F.lit(1))).alias("cycle"))


def cycle_slots(shares: DataFrame) -> DataFrame:
    """(source, turn, slot) of one cycle, in which each source has as many blocks as quanta."""
    return schedule(shares.withColumn("n", F.col("q")))


def schedule(shares: DataFrame) -> DataFrame:
    """(source, turn, slot) of all ``n`` blocks of each source of (source, q, cycle, n), the share of a source being q / cycle.

    Earliest deadline first among released blocks, and among all next blocks where none is released, as happens once a
    source has ended; ties go to the source that sorts first. The one row that is folded has an entry for each source
    and runs over as many slots as there are blocks; picks are gathered in runs of ``RUN``, so that appending stays cheap.
    """
    one = shares.agg(
        F.array_sort(F.collect_list(F.struct("source", "q", "n", F.lit(0).cast("long").alias("done")))).alias("start"),
        F.max("cycle").alias("cycle"),
        F.sum("n").alias("blocks"),
    ).where("blocks > 0")
    # deadline of block i: ceil((i + 1) * cycle / q); released once i * cycle < q * (slot + 1), all in whole numbers
    step = """transform(array(array_min(transform(acc.state, (s, k) ->
                 if(s.done < s.n,
                    named_struct('waits', if(s.done * cycle < s.q * (slot + 1), 0, 1), 'deadline', ((s.done + 1) * cycle + s.q - 1) div s.q, 'k', k, 'turn', s.done),
                    cast(null as struct<waits:int,deadline:bigint,k:int,turn:bigint>))))),
               best -> named_struct(
                 'state', transform(acc.state, (s, k) -> if(k = best.k, named_struct('source', s.source, 'q', s.q, 'n', s.n, 'done', s.done + 1), s)),
                 'picked', concat(acc.picked, array(named_struct('k', best.k, 'turn', best.turn)))))[0]"""
    run = f"""aggregate(
                sequence(c * {RUN}L, least((c + 1) * {RUN}L, blocks) - 1),
                named_struct('state', whole.state, 'picked', cast(array() as array<struct<k:int,turn:bigint>>)),
                (acc, slot) -> {step})"""
    folded = one.selectExpr(
        f"""aggregate(
             sequence(0L, (blocks - 1) div {RUN}),
             named_struct('state', start, 'picked', cast(array() as array<array<struct<k:int,turn:bigint>>>)),
             (whole, c) -> transform(array({run}), r -> named_struct('state', r.state, 'picked', concat(whole.picked, array(r.picked))))[0]
           ).picked AS picked""",
        "start",
    )
    runs = folded.selectExpr("posexplode(picked) AS (c, picks)", "start").selectExpr("c", "posexplode(picks) AS (at, pick)", "start")
    return runs.selectExpr("start[pick.k].source AS source", f"cast(c as bigint) * {RUN} + at AS slot", "pick.turn AS turn")


def numbered(docs: DataFrame, rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The documents with ``__mix_number``: their place, from 0, in a pseudo-random order of their source.

    Ranges of a hash split every source, however large, into buckets of less than ``rows_per_bucket`` rows; numbers
    are counted in each bucket and moved by the sizes of the buckets before it.
    """
    buckets = max(1, -(-rows // rows_per_bucket)) * 4
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    keyed = docs.withColumn("__mix_h", h).withColumn("__mix_bucket", F.floor(F.col("__mix_h") * buckets / F.lit(2**32)).cast("int"))
    sizes = keyed.groupBy("source", "__mix_bucket").agg(F.count("*").alias("__mix_n"))
    before = F.sum("__mix_n").over(W.partitionBy("source").orderBy("__mix_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(F.col("source").alias("__mix_s"), F.col("__mix_bucket").alias("__mix_b"), F.coalesce(before, F.lit(0)).alias("__mix_start"))
    own = W.partitionBy("source", "__mix_bucket").orderBy("__mix_h", "doc_id")
    local = keyed.withColumn("__mix_row", F.row_number().over(own) - 1)
    joined = local.join(starts, F.col("source").eqNullSafe(F.col("__mix_s")) & (F.col("__mix_bucket") == F.col("__mix_b")))
    return joined.withColumn("__mix_number", F.col("__mix_row") + F.col("__mix_start"))


#: What ``mix`` adds; columns of the input with these names give way.
ADDED = ("block", "cycle", "slot", "position")


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, slots_per_source: int = SLOTS_PER_SOURCE, power: float = POWER) -> DataFrame:
    """Every document once, with its source's block, that block's cycle and slot, and ``position``, by which they sort into the mix.

    ``weights`` has (source, weight); without it ``default_weights`` sets the target. A null source is a source of
    its own; one that isn't in ``weights`` gets the least quantum. The last block of a source may be short. While
    all sources last, each lies less than one block from its weight after any block; once a source has ended, the
    others go on by their deadlines. Positions have gaps only after short blocks. Rows repeated whole are documents
    of their own. An empty table gives an empty mix. Other columns stay.
    """
    docs = docs.drop(*ADDED)
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    rows, sources = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if weights is None:
        target = default_weights(sizes, power)
    else:
        given = weights.groupBy(F.col("source").alias("__mix_w")).agg(F.max("weight").alias("weight"))
        target = sizes.join(given, F.col("source").eqNullSafe(F.col("__mix_w")), "left").select("source", "weight")
    # a row for each source in both
    blocks = sizes.select(F.col("source").alias("__mix_s2"), F.ceil(F.col("n") / block).alias("n"))
    shares = quanta(target, QUANTA // max(sources, 1)).join(F.broadcast(blocks), F.col("source").eqNullSafe(F.col("__mix_s2"))).drop("__mix_s2")
    plan = schedule(shares).select(F.col("source").alias("__mix_s2"), F.col("turn").alias("__mix_turn"), F.col("slot").alias("__mix_slot"))
    length = max(sources, 1) * slots_per_source
    number = numbered(docs, rows)
    number = number.withColumn("block", F.floor(F.col("__mix_number") / block))
    placed = number.join(plan, F.col("source").eqNullSafe(F.col("__mix_s2")) & (F.col("block") == F.col("__mix_turn")))  # a row for each block
    placed = (
        placed.withColumn("cycle", F.floor(F.col("__mix_slot") / length))
        .withColumn("slot", F.pmod("__mix_slot", F.lit(length)))
        .withColumn("position", F.col("__mix_slot") * block + F.pmod("__mix_number", F.lit(block)))
    )
    return placed.select(*docs.columns, *ADDED)
