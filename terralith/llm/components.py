"""Connected components of a graph that may be as large as the corpus, by large-star and small-star steps.

Each step replaces edges (u, v) by edges towards the least vertex seen, until every vertex points to the
least one of its component. Edges are rows; nothing of their number reaches the driver. A vertex with very many
neighbours is only ever a key of an aggregate and of a join that deals its edges out to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, remove, written


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Neighbours above a vertex are linked to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    above = join_spread(both.where("v > u"), least, ["u"], ["v"], total=2 * n)
    return above.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Neighbours below a vertex, and the vertex, are linked to the least of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    linked = join_spread(edges, least, ["u"], ["v"], total=n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id that it is linked with) of every id in links (a, b) but the least ones themselves.

    Links may repeat, point either way or to themselves. Without links there are no rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        after_edges = written(_small_star(_large_star(edges, before[0]), before[0]), "links")
        remove(edges.sparkSession, edges)
        edges, after = after_edges, _state(after_edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
