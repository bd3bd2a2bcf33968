"""Mixing sources to target weights by a low-discrepancy schedule.

Method. Van der Corput points are mapped through the cumulative target weights: the point of slot ``i`` is ``i`` with its
binary digits mirrored behind the point, and the slot belongs to the source whose interval the point falls into, so every
stretch of the schedule holds the sources near their weights, and all of it within one slot of them. Slots are ranked per
source; slot ``r`` of a source takes block ``r``. Blocks are equal for all sources: the words of the mix shared evenly
among the slots. Those of a source are equal stretches of its documents in shuffled order, laid end to end and repeated up
to ``max_repeats`` times. What a source gives is what its slots hold, so it meets its target to about one block; a target
too small for any point has one slot after the last, cut at the target.

Shuffled order is that of ``md5(doc_id)``, the same on every run. Running sums are taken in two
levels, over ranges of that order and then within each, so that a source holding most of the rows is
not one task's work.

Edge cases. Null, empty and blank texts have size 0 and are taken 0 times. A null source is a source of
its own, the last in order. Repeated rows count each for itself; rows with equal ``doc_id`` and source
share one place in the order. Rows with a null ``doc_id`` take part, in the order of their texts' digests. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stash

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: shares of the whole by weight, none above its cap.

    A source whose cap is below its share keeps the cap and the rest is shared anew by weight until no
    source is above. Sources in order of cap over weight reach their caps in that order, so one running
    sum finds them all. One row per source: the table is as small as the list of sources.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rank = F.row_number().over(every) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.withColumn("rank", rank)
        .withColumn("weight", F.get(cycle, F.col("rank") % len(weights)))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
        .select("source", "source_size", "rank", "target", F.floor("target").cast("long").alias("quota"))
    )


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """``(slot, rank, turn)``: which source each slot is given to and the slot's rank within it.

    ``plan`` is what :func:`targets` returns. With ``grid`` the next power of two after ``slots``, the points are the
    multiples of ``1 / grid``, so a source's slots follow from the ends of its interval. A source that no point hits gets
    one slot after the last.
    """
    bits = max(1, (slots - 1).bit_length())
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = plan.where("quota > 0").select("rank", "quota", F.sum("quota").over(upto).alias("upto"), F.sum("quota").over(Window.partitionBy()).alias("total"))
    place = lambda words: F.expr(f"({words} * {1 << bits} + total - 1) div total")
    points = sums.select("rank", place("(upto - quota)").alias("low"), (place("upto") - 1).alias("high")).where("low <= high").select("rank", F.explode(F.sequence("low", "high")).alias("point"))
    mirrored = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    hit = points.select(mirrored.alias("slot"), "rank").where(F.col("slot") < slots)
    unhit = sums.join(hit.select("rank").distinct(), "rank", "left_anti").select((F.lit(slots) + F.col("rank")).cast("long").alias("slot"), "rank")
    # At most ``slots`` rows and one for each source, however large the corpus is.
    return hit.unionByName(unhit).withColumn("turn", (F.row_number().over(Window.partitionBy("rank").orderBy("slot")) - 1).cast("long"))


def laid_out(sized: DataFrame, ranges: int = 1024) -> DataFrame:
    """Adds ``start``: how many of the source's words come before the document in shuffled order, that of ``key``."""
    keyed = sized.withColumn("range", (F.conv(F.substring("key", 1, 4), 16, 10).cast("int") % 65536 * ranges / 65536).cast("int"))
    sums = keyed.groupBy("rank", "range").agg(F.sum("size").alias("n"))
    earlier = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("rank", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.join(earlier, ["rank", "range"]).withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("before")).drop("key", "range", "before")


def _pieces(docs: DataFrame, weights: tuple[float, ...], max_repeats: int, slots: int, ranges: int) -> DataFrame:
    """``(row, doc_id, size, source_size, target, slot, copy, begin, words)``: what each slot's block takes of each row.

    ``row`` tells all rows apart. Rows of which nothing is taken are there as well, with 0 words.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5("text")), F.lit("")))
    sized, _ = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row")), "sizes")
    plan, _ = stash(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats), "targets", narrow=True)
    turns, _ = stash(schedule(plan, slots), "schedule", narrow=True)
    whole = plan.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
    # Block t of a source begins at the first word w with w * slots >= t * whole.
    got = turns.groupBy("rank").agg(F.count("*").alias("turns"), (F.min("slot") < slots).alias("hit"))
    stream = F.when(F.col("hit"), F.col("source_size") * max_repeats).otherwise(F.col("quota"))
    reach = F.when(F.col("turns") > 0, F.least(F.expr(f"(turns * {whole}L + {slots - 1}) div {slots}"), stream)).otherwise(0)
    plan = plan.join(got, "rank", "left").withColumn("reach", reach).select("source", "source_size", "rank", "target", "reach")
    placed = laid_out(sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop("source"), ranges)

    copies = placed.withColumn("copy", F.explode(F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(max_repeats - 1))).otherwise(F.array(F.lit(0)))))
    copies = copies.withColumn("first", F.col("start") + F.col("copy") * F.col("source_size")).withColumn("end", F.least(F.col("first") + F.col("size"), F.col("reach")))
    live = F.col("end") > F.col("first")
    at = lambda word: F.expr(f"({word} * {slots}L) div {max(1, whole)}L")
    pieces = copies.withColumn("turn", F.explode(F.when(live, F.sequence(at("first"), at("(end - 1)"))).otherwise(F.array(F.lit(-1).cast("long")))))
    joined = pieces.where("turn >= 0 or copy = 0").join(turns, ["rank", "turn"], "left")
    edge = lambda turn: F.expr(f"({turn} * {whole}L + {slots - 1}) div {slots}")
    begin = F.greatest(F.col("first"), edge("turn"))
    part = F.when(F.col("slot").isNotNull(), F.least(F.col("end"), edge("(turn + 1)")) - begin).otherwise(0)
    return joined.select("row", "doc_id", "size", "source_size", "target", "slot", "copy", (begin - F.col("first")).alias("begin"), part.cast("long").alias("words"))


def blocks(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, slots: int = 1 << 16, ranges: int = 1024) -> DataFrame:
    """``(slot, doc_id, copy, first, last)``: the mix itself, as stretches of words of documents, counted from 0, by slot."""
    pieces = _pieces(docs, weights, max_repeats, slots, ranges).where("words > 0")
    return pieces.select("slot", "doc_id", "copy", F.col("begin").cast("long").alias("first"), (F.col("begin") + F.col("words") - 1).cast("long").alias("last"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, slots: int = 1 << 16, ranges: int = 1024) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, a row for each row of ``docs(doc_id, text, source)``.

    ``slots`` is the length of the schedule, of which each slot takes one block, and ``ranges`` the number of stretches of
    the shuffled order, which do not change the result.
    """
    pieces = _pieces(docs, weights, max_repeats, slots, ranges)
    return pieces.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")
