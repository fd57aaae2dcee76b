"""Mixing sources to target weights by a low-discrepancy schedule.

Every source lays its shuffled documents end to end on a line of words, repeated as often as its target needs (three times at
most), and cuts that line into blocks of equally many words.  The schedule has one slot per block of the mix.  Slot i takes the
i-th van der Corput point, maps it through the cumulative target weights to a source and, as the r-th slot of that source, takes
its r-th block.  Any stretch of the schedule so holds the sources nearly in their proportions.

Null or empty text has size 0 and is never taken.  A null source is a source of its own, ordered last.  Repeated rows and
repeated or null ids are rows like any other (equal rows are interchangeable).  An empty table gives an empty mix.  Ties in the
shuffle are broken by id, then size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.batches import chunks, text_bytes, words
from callweave.session import cut

WEIGHTS = [5, 2, 1]
MOST_REPEATS = 3
BLOCK_WORDS = 256  # the largest block; small corpora use smaller ones, so that there are at least LEAST_SLOTS blocks
LEAST_SLOTS = 1 << 16
CELLS = 4096  # of the unit interval, to look up the source of a point by an equi-join


def sized(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(key, doc_id, source, size): size is the number of words; ``key`` (a long) finds the row again."""

    def count(batches):
        for batch in chunks(batches):
            _, _, before = words(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), batch.column("source"), pa.array(before[1:] - before[:-1])],
                                             names=["key", "doc_id", "source", "size"])

    doc_id = F.col("doc_id").cast("long")
    picked = docs.select((doc_id if key is None else key).alias("key"), doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"),
                         F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(count, "key long, doc_id long, source string, size long")


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source_size and target.

    Sources in code-point order (null last) weigh 5, 2, 1, repeating.  Reading them by falling weight per word, a source is
    capped at three times its size while its fair share of what is left exceeds that; the others share the rest by weight.  The
    table has a row per source, aggregated, so ordering it in one task is cheap.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(order) - 1
    weigh = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    ranked = total.select("source", "source_size", place.alias("place"), weigh.cast("double").alias("weight"))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole) - MOST_REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levels = ranked.withColumn("level", level)
    # The first source that its level fits: from there on nobody is capped.
    fits = F.min(F.when(F.col("level") * F.col("weight") <= MOST_REPEATS * F.col("source_size"),
                        F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(whole)
    return levels.select("source", "place", "source_size",
                         F.least(F.col("weight") * fits["level"], (MOST_REPEATS * F.col("source_size")).cast("double")).alias("target"))


def _running(df: DataFrame, group: list[str], coarse: str, fine: list[str], value: Column, name: str) -> DataFrame:
    """Running sum of ``value`` before each row of a group, in two levels: no task holds a whole group."""
    parts = df.groupBy(*group, coarse).agg(F.sum(value).alias("_part"))
    ahead = Window.partitionBy(*group).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col(coarse).alias("_coarse"),
                         F.coalesce(F.sum("_part").over(ahead), F.lit(0)).alias("_ahead"))
    match = F.col(coarse) == F.col("_coarse")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_{g}"))
    inner = Window.partitionBy(*group, coarse).orderBy(*fine).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(parts, match)
    return joined.select(*df.columns, (F.col("_ahead") + F.col("_inner")).alias(name))


def _reversed_bits(i: Column) -> Column:
    """The 32 low bits of ``i`` in reverse order."""
    for shift, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
        low = F.shiftleft(i.bitwiseAND(F.lit(mask).cast("long")), shift)
        i = low.bitwiseOR(F.shiftright(i, shift).bitwiseAND(F.lit(mask).cast("long")))
    return i


def corput(i: Column) -> Column:
    """The i-th van der Corput point in base 2, for i below 2^52."""
    high = F.shiftright(i, 32)
    return _reversed_bits(i.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))) / F.lit(2.0 ** 32) + _reversed_bits(high) / F.lit(2.0 ** 64)


def schedule(goals: DataFrame, n_slots: int) -> DataFrame:
    """(slot, place, rank): the source of each slot and which of its blocks it takes."""
    spark = goals.sparkSession
    whole = Window.partitionBy()
    upto = Window.orderBy("place")
    share = goals.where(F.col("target") > 0).select("place", (F.sum("target").over(upto) / F.sum("target").over(whole)).alias("high"),
                                                    F.sum("target").over(whole).alias("_all"), "target")
    share = share.withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0)))
    # The last interval reaches past the end, whatever rounding did to its upper bound.
    share = share.withColumn("high", F.when(F.lead("high").over(upto).isNull(), F.lit(2.0)).otherwise(F.col("high")))
    cells = share.select("place", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS),
                                                                      F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS)))).alias("_cell"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), corput(F.col("id")).alias("_x"))
    slots = slots.withColumn("_cell", F.floor(F.col("_x") * CELLS))
    dealt = slots.join(cells, "_cell").where((F.col("_x") >= F.col("low")) & (F.col("_x") < F.col("high")))
    stretch = max(1, round(n_slots ** 0.5))
    dealt = dealt.select("slot", "place", F.floor(F.col("slot") / stretch).alias("_stretch"))
    return _running(dealt, ["place"], "_stretch", ["slot"], F.lit(1), "rank").drop("_stretch")


def mix(docs: DataFrame, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The sized documents (key, doc_id, source, size, source_size, target, _start) and the scheduled pieces of them.

    A piece says which words of a document a slot takes: (slot, source, rank, doc_id, size, _start, first, n), ``first`` counted
    from 0 in the document.  ``_start`` is where the document begins on its source's line.
    """
    sizes = cut(sized(docs, key), "sizes")
    n_docs, n_words = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = min(BLOCK_WORDS, max(1, n_words // LEAST_SLOTS))
    goals = targets(sizes)
    groups = max(1, round(n_docs ** 0.5))
    dice = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    lined = sizes.withColumn("_dice", dice).withColumn("_group", F.pmod(F.col("_dice"), F.lit(groups)))
    lined = _running(lined, ["source"], "_group", ["_dice", "doc_id", "size", "key"], F.col("size"), "_start")
    lined = lined.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select(
        "key", "doc_id", "d.source", "size", "source_size", "target", "_start", "place")
    lined = cut(lined, "lined")
    n_slots = -(-n_words // block)
    slots = schedule(goals, n_slots).withColumnRenamed("place", "_place")
    # A document's words on the repeated line, as far as the target reaches, then cut at block borders.
    turns = lined.where(F.col("size") > 0).select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1))).alias("_turn"))
    turns = turns.withColumn("_from", F.col("_turn") * F.col("source_size") + F.col("_start"))
    turns = turns.where(F.col("_from") < F.col("target") + 64 * block)
    parts = turns.select("*", F.explode(F.sequence(F.floor(F.col("_from") / block),
                                                   F.floor((F.col("_from") + F.col("size") - 1) / block))).alias("rank"))
    first = F.greatest(F.col("_from"), F.col("rank") * block)
    last = F.least(F.col("_from") + F.col("size"), (F.col("rank") + 1) * block)
    parts = parts.select("doc_id", "source", "size", "_start", "place", "rank", (first - F.col("_from")).alias("first"), (last - first).alias("n"))
    pieces = parts.join(slots, (parts["place"] == slots["_place"]) & (parts["rank"] == slots["rank"])).select(
        "slot", "source", "place", parts["rank"], "doc_id", "size", "_start", "first", "n")
    return lined, pieces


def taken(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """Per document: how many of its words the mix takes, repeats counted."""
    lined, pieces = mix(docs, key)
    got = pieces.groupBy(F.col("place").alias("_place"), F.col("_start").alias("_at")).agg(F.sum("n").alias("_n"))
    joined = lined.join(got, (F.col("place") == F.col("_place")) & (F.col("_start") == F.col("_at")) & (F.col("size") > 0), "left")
    return joined.select("key", "doc_id", "size", "source_size", "target", F.coalesce("_n", F.lit(0)).cast("long").alias("taken"), "source")
