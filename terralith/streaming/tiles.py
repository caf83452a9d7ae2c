"""Tiles of pixels as they arrive: a file stream whose batches are summarised, and running features of segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spectral import band_columns


def tile_stream(spark: SparkSession, folder: str, schema, files_at_once: int = 16) -> DataFrame:
    """Pixel relations written to a folder as Parquet files, a bounded number in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def running_spectral(stream: DataFrame) -> DataFrame:
    """n, mean, min and max of each band by image and segment so far: the state is one row for each segment."""
    stats = [f(F.col(c).cast("double")).alias(f"{s}_{c}") for c in band_columns(stream) for s, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return stream.where("segment_id > 0").groupBy("image_id", "segment_id").agg(F.count(F.lit(1)).alias("n"), *stats)


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], output: str, checkpoint: str):
    """Starts writing work's result for each batch to a sub-folder of output; a batch that is repeated after a
    failure replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
