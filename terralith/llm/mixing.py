"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

The rows of each source, in an order of their own that a hash gives, are cut into blocks. With a whole weight a
of a total Q, block j of a source is released in slot floor(j Q / a) and due before slot ceil((j + 1) Q / a).
In each slot the released block with the earliest deadline is taken. All deadlines are met, so after any slot
each source is less than one block from its share. The schedule repeats every Q slots; one round of it, a table
of Q rows whatever the input, is worked out by an aggregate over its slots and joined to the blocks. Sources of equal
weight take turns, so that a slot looks at one source of each weight, of which there are at most about sqrt(2 Q).

A source that has run out leaves its slots empty; the others keep their distances to their shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, row_hash

#: Slots of a round that are dealt out by weight, beside one for each source.
ROUND = 1000
#: Rows of a block.
BLOCK = 64
#: Hex digits of a row's hash that its source's rows are split by, so that a large source is many groups.
DIGITS = 3


def smoothed_weights(docs: DataFrame) -> DataFrame:
    """source, weight: 1 and a share of ROUND by the square root of the source's rows, so that small sources count
    for more than their size. Whole numbers throughout. Null is the source ''."""
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.floor(F.sqrt(F.count(F.lit(1)))).cast("bigint").alias("root"))
    total = counts.agg(F.sum("root").alias("total"))
    return counts.join(F.broadcast(total)).select("source", F.expr(f"1 + ({ROUND} * root) div total").alias("weight"))


#: Slots whose picks are gathered in one array.
SLOTS = 256


def _picks(sources: Column) -> Column:
    """The number of the source taken in each slot of a round. sources: array<struct<source, weight>>."""
    weights = F.array_sort(F.array_distinct(F.transform(sources, lambda s: s["weight"])))
    members = lambda w: F.filter(F.transform(sources, lambda s, i: F.when(s["weight"] == w, i)), lambda i: i.isNotNull())
    classes = F.transform(weights, lambda w: F.struct(w.alias("weight"), members(w).alias("members")))
    long = lambda x: F.lit(x).cast("bigint")

    def scheduled(known: Column) -> Column:
        of, q = known["classes"], known["q"]
        none = F.array().cast("array<int>")

        def slot(state: Column, t: Column) -> Column:
            def due(done: Column, k: Column) -> Column:
                """The deadline of the next job of a weight: its sources' jobs j in turn, then their jobs j + 1."""
                own = F.get(of, k)
                job, turn = F.floor(done / F.size(own["members"])), (done % F.size(own["members"])).cast("int")
                released = F.floor(job * q / own["weight"]) <= t
                return F.when(released & (job < own["weight"]), F.struct(F.ceil((job + 1) * q / own["weight"]).alias("deadline"), F.get(own["members"], turn).alias("i"), k.alias("k")))

            def taken(pick: Column) -> Column:
                return F.struct(
                    F.transform(state["done"], lambda d, k: F.when(k == pick["k"], d + 1).otherwise(d)).alias("done"),
                    F.concat(state["picks"], F.array(pick["i"])).alias("picks"),
                )

            return let(F.array_min(F.transform(state["done"], due)), taken)

        def stretch(state: Column, first: Column) -> Column:
            slots = F.sequence(first, F.least(first + SLOTS, q) - 1)
            inner = F.aggregate(slots, F.struct(state["done"].alias("done"), none.alias("picks")), slot)
            return let(inner, lambda x: F.struct(x["done"].alias("done"), F.concat(state["all"], F.array(x["picks"])).alias("all")))

        start = F.struct(F.transform(of, lambda c: long(0)).alias("done"), F.array().cast("array<array<int>>").alias("all"))
        return F.aggregate(F.sequence(long(0), q - 1, long(SLOTS)), start, stretch, lambda s: F.flatten(s["all"]))

    total = F.aggregate(sources, long(0), lambda a, s: a + s["weight"])
    return let(F.struct(classes.alias("classes"), total.alias("q")), scheduled)


def schedule(weights: DataFrame) -> DataFrame:
    """source, weight, total, turn (from 0), slot: one round. weights: source, weight (whole, above 0), one row for
    each source; their number bounds the table."""
    one = weights.agg(F.array_sort(F.collect_list(F.struct("source", F.col("weight").cast("bigint").alias("weight")))).alias("sources")).where(F.size("sources") > 0)
    rows = one.select("sources", F.posexplode(_picks(F.col("sources"))).alias("slot", "i"))
    rows = rows.select("slot", F.get("sources", F.col("i")).alias("s"), F.aggregate("sources", F.lit(0).cast("bigint"), lambda a, s: a + s["weight"]).alias("total"))
    turn = F.row_number().over(Window.partitionBy("s.source").orderBy("slot")) - 1
    return rows.select("s.source", "s.weight", "total", turn.alias("turn"), F.col("slot").cast("bigint").alias("slot"))


def placed_rows(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of docs as a struct row, with their places in the mix."""
    tie = row_hash(docs)
    source, order = F.coalesce("source", F.lit("")), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), tie.cast("string"))))
    part = F.substring(order, 1, DIGITS)
    keyed = docs.select(source.alias("source"), order.alias("order"), part.alias("part"), F.col("doc_id").alias("doc"), tie.alias("tie"), F.struct(*docs.columns).alias("row"))
    sizes = docs.select(source.alias("source"), part.alias("part")).groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    # at most 16^DIGITS numbers for each source
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("source", "part", F.coalesce(before, F.lit(0)).alias("before"))
    if weights is None:
        weights = smoothed_weights(docs)
    else:
        weights = docs.select(source.alias("source")).distinct().join(weights, "source", "left").select("source", F.coalesce("weight", F.lit(1)).alias("weight"))
    round_ = schedule(weights)
    rank = F.row_number().over(Window.partitionBy("source", "part").orderBy("order", "doc", "tie")) - 1
    placed = keyed.select("source", "part", "row", rank.alias("rank")).join(offsets, ["source", "part"]).select("source", "row", (F.col("rank") + F.col("before")).alias("index"))
    per_source = F.broadcast(round_.groupBy("source").agg(F.first("weight").alias("weight")))
    placed = placed.join(per_source, "source").withColumn("block", F.floor(F.col("index") / block).cast("bigint")).withColumn("turn", F.col("block") % F.col("weight"))
    # one round: as many rows as its slots
    dealt = placed.join(F.broadcast(round_.drop("weight")), ["source", "turn"])
    slot = F.expr("block div weight") * F.col("total") + F.col("slot")
    return dealt.select("row", F.col("weight").alias("mix_weight"), F.col("total").alias("mix_total"), F.col("block").alias("mix_block"), slot.alias("mix_slot"), (F.col("index") % block).cast("bigint").alias("mix_place"))


ADDED = ("mix_weight", "mix_total", "mix_block", "mix_slot", "mix_place")


def mixed(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """docs with mix_weight, mix_total, mix_block (of the row's source, from 0), mix_slot and mix_place (in the
    block, from 0), in place of columns of these names.

    Read in the order of slot and place, every stretch has the target weights. No row is left out or repeated:
    rows of sources without a weight get the smallest weight of 1. A null source is the source '', whose name
    stays null; rows without a doc_id are ordered by a hash of all columns. Rows with equal doc_id are in the order of
    that hash.
    """
    return placed_rows(docs.drop(*ADDED), weights, block).select("row.*", *ADDED)


def in_order(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of docs, with its columns, in the order of the mix: written files hold it from first to last."""
    return placed_rows(docs, weights, block).repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select("row.*")
