"""Shared helpers: tables written to the cluster's shared folder, and running positions without one big window."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import new_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps neither repeat its work nor depend on
    the executors that did it."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete scratch tables made by ``stored`` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions the cluster is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def offsets(counts: DataFrame, bucket: str, n: str, width: int = 1024) -> DataFrame:
    """``counts`` (one row per integer bucket) with ``before``: the total of all smaller buckets.

    Buckets are summed in blocks of ``width`` first, so no task orders more than ``width`` buckets or all the blocks.
    """
    c = counts.withColumn("_block", F.floor(F.col(bucket) / width))
    blocks = c.groupBy("_block").agg(F.sum(n).alias("_n"))
    blocks = blocks.select("_block", (F.sum("_n").over(W.orderBy("_block")) - F.col("_n")).alias("_ahead"))
    inside = F.sum(n).over(W.partitionBy("_block").orderBy(bucket)) - F.col(n)
    return (c.withColumn("_inside", inside).join(blocks, "_block")
            .withColumn("before", F.col("_inside") + F.col("_ahead")).drop("_block", "_inside", "_ahead"))


def utf8_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of the steps that are over."""
    import gc
    gc.collect()
    spark._jvm.System.gc()
