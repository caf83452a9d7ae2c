"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2^16 cells of equal width. Each shard owns several virtual nodes; a key belongs to the first
node at or after its cell. A shard holds no more rows than its bound; keys that find it full continue
clockwise to the next node of a shard with room. With the bounds at the mean, rounded up for as many shards
as needed and down for the others, counts are at most one apart.

Only the counts of the cells, at most 2^16 numbers whatever the input, reach the driver. There the arcs are
filled and each cell gets the ranges of ranks that go to each shard; rows take their place by their rank.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash, text_or_empty

#: Cells of the ring.
CELLS = 1 << 16
#: Values of the first order column that are numbered together.
STRETCH = 32


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in clockwise order; a cell taken by a lower shard stays with it."""
    taken: dict[int, int] = {}
    for s in range(shards):
        for v in range(nodes):
            taken.setdefault(xxhash.xxh64_intdigest(f"shard {s} node {v}") % CELLS, s)
    return sorted(taken.items())


def allotted(counts: dict[int, int], shards: int, nodes: int, bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first rank): where the rows of each cell go.

    Arcs are filled in clockwise order, the rows that a node's own shard takes first; then what is left of
    each arc walks on, node by node, until a shard has room.
    """
    at = ring(shards, nodes)
    room, used = list(bounds), [0] * shards
    out, left = [], []
    cells = sorted(counts)
    k = 0
    for cell in cells:
        while k < len(at) and at[k][0] < cell:
            k += 1
        own = at[k % len(at)][1]
        n = counts[cell]
        take = min(n, room[own])
        if take:
            out.append((cell, 0, take, own, used[own]))
            room[own] -= take
            used[own] += take
        if take < n:
            left.append((cell, take, n, k % len(at)))
    for cell, first, n, k in left:
        step = 1
        while first < n:
            s = at[(k + step) % len(at)][1]
            take = min(n - first, room[s])
            if take:
                out.append((cell, first, first + take, s, used[s]))
                room[s] -= take
                used[s] += take
                first += take
            step += 1
    return out


def row_bounds(rows: int, shards: int) -> list[int]:
    """The tightest bounds that hold all rows."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def ring_cell(position: Column) -> Column:
    return F.shiftrightunsigned(position, 48).cast("int")


def ring_shards(docs: DataFrame, shards: int = 8, nodes: int = 128, content: Column | None = None) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (gapless from 0 in each shard), in place of columns of these names.

    A row's place on the ring is the hash of its doc_id and its content (a hash of all columns, unless content is
    given), so that rows without a doc_id, rows of one doc_id, and copies of a text are spread. Rows of one place are
    ordered by doc_id and content, so that a recomputed task deals them out alike. Maps count by their JSON. An empty
    table gives no rows.
    """
    docs = docs.drop("shard", "slot")
    tie = row_hash(docs) if content is None else content
    placed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), tie)
    counts = {r["cell"]: r["n"] for r in docs.select(ring_cell(placed).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = allotted(counts, shards, nodes, row_bounds(sum(counts.values()), shards))
    dealt = docs.sparkSession.createDataFrame(ranges, "of int, first bigint, end bigint, shard int, start bigint")
    keyed = docs.select(placed.alias("position"), ring_cell(placed).alias("cell"), F.col("doc_id").alias("doc"), tie.alias("tie"), F.struct(*docs.columns).alias("row"))
    ranked = keyed.select("row", "cell", (F.row_number().over(Window.partitionBy("cell").orderBy("position", "doc", "tie")) - 1).alias("rank"))
    # at most one row for each cell and shard: of bounded size
    joined = ranked.join(F.broadcast(dealt), (F.col("cell") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return joined.select("row.*", "shard", (F.col("start") + F.col("rank") - F.col("first")).alias("slot"))


def slots_by(rows: DataFrame, major: str, minor: str) -> DataFrame:
    """rows (shard, slot, and whole numbers major and minor) with each shard's slots, gapless from 0, in the order of
    major and minor.

    Rows are ranked in stretches of major, so that a shard is many groups; only the sizes of its stretches are
    summed up along it.
    """
    rows = rows.withColumn("_stretch", F.floor(F.col(major) / STRETCH))
    sizes = rows.groupBy("shard", "_stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("shard", "_stretch", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_stretch").orderBy(major, minor)) - 1
    out = rows.withColumn("_rank", rank).join(offsets, ["shard", "_stretch"])
    return out.withColumn("slot", (F.col("_before") + F.col("_rank")).cast("bigint")).select(*rows.drop("_stretch").columns)


def sharded(docs: DataFrame, shards: int = 8, nodes: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text).

    size is the text's UTF-8 bytes (null: none) plus 1. The law is "rows": counts at most one apart. A row's content is
    its text: other columns are not read.
    """
    rows = docs.select("doc_id", (F.octet_length(text_or_empty()) + 1).cast("bigint").alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    out = ring_shards(rows, shards, nodes)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
