"""What the text operators share: the shared folder, written intermediates, input columns, bytes of a batch."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that the contracts treat as white space.
SPACE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is absent, as in tests on one machine, a temporary folder is set in its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="terralith-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that a lost executor costs no recomputation of its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by written() which nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8, null as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column
    return [x or b"" for x in column.to_pylist()]


#: A key with more than one in so many of all rows is hot. There are fewer than so many of them.
PARTS = 4096


def join_spread(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], n: str = "n", total: int | None = None, how: str = "inner") -> DataFrame:
    """many joined with one, which has a row for each of the keys and in n how many rows of many it has, about.

    The rows of hot keys are dealt by the columns by to shares of about one PARTS-th of total (the sum of n, unless it
    is given), so that no task gets more of them than of other keys. Each share meets a copy of one's row; all keys
    together have fewer than PARTS copies more. Which keys are hot is broadcast, as there are fewer than PARTS. Null
    keys meet nothing; how="left" keeps their rows, dealt by the columns by too. The result keeps n.
    """
    if total is None:
        total = one.agg(F.sum(n)).first()[0]
    total = max(int(total or 0), 1)
    shares = F.when(F.col(n) * PARTS > total, F.ceil(F.col(n) * PARTS / total)).otherwise(1).cast("bigint")
    hot = one.where(F.col(n) * PARTS > total).select(*keys, shares.alias("_shares"))
    if len(set(many.columns) & {"_shares", "_share"}):
        raise ValueError("_shares and _share are names of this join")
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    place = F.xxhash64(*by)
    share = F.when(F.col("_shares").isNotNull(), F.pmod(place, F.col("_shares"))).when(missing, F.pmod(place, F.lit(PARTS))).otherwise(0)
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("_share", share.cast("bigint")).drop("_shares")  # fewer than PARTS rows
    copies = one.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)))
    return dealt.join(copies, [*keys, "_share"], how).drop("_share")


def row_hash(df: DataFrame, within: str = "") -> Column:
    """A hash of all columns of df, or of a struct column within that has them as fields, which rows of the same
    content share; columns with maps go by their JSON."""

    def part(field) -> Column:
        value = F.col(f"{within}.`{field.name}`" if within else f"`{field.name}`")
        kind = field.dataType.simpleString()
        return F.to_json(F.struct(value.alias("v"))) if "map<" in kind or "variant" in kind else value

    return F.xxhash64(*map(part, df.schema.fields))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]
