"""Session helpers: a builder for local work and the checkpoint folder rule."""
from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", name: str = "ledgerlens", partitions: int | None = None) -> SparkSession:
    """A local session. ``partitions``: shuffle partitions for small data; by default Spark's own setting counts."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.driver.memory", os.environ.get("LEDGERLENS_MEMORY", "12g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master with nothing configured (tests) gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="ledgerlens-")
        sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """A fresh path under the shared folder for tables written and read back."""
    return f"{shared_folder(spark)}/ledgerlens-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, for tables that several steps use."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> DataFrame:
    """``df`` written as by ``stored``; Spark is then let remove the shuffle files of the steps that led to it."""
    out = stored(df)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through reliable storage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
