"""The text pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns that they are given, and rows read again have no order, so
the last works out their places in the mix anew, from the same rows, and numbers the slots of each shard by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import row_hash, table, written
from terralith.llm.decontaminate import cleaned
from terralith.llm.mixing import in_order, placed_rows
from terralith.llm.near_dups import near_duplicates
from terralith.llm.quality_rules import kept_rows
from terralith.llm.sharding import ring_shards, slots_by


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates, and what is in no group."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; those that consist of them to a fifth or more go."""
    return cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order whose stretches have the target weights of the sources."""
    return in_order(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it, slots in the order of the mix."""
    docs = docs.drop("shard", "slot")
    placed = placed_rows(docs).select(F.col("row")["doc_id"].alias("doc_id"), "row", "mix_slot", "mix_place")
    return slots_by(ring_shards(placed, content=row_hash(docs, "row")), "mix_slot", "mix_place").select("row.*", "shard", "slot")


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shards)]

#: Sketches and rings are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs.select(*[F.col(c) for c in docs.columns])
